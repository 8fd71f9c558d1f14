"""Spark-native log analytics. The names below are loaded when they are first asked for."""

import importlib

_PLACES = {
    "analyze": "plans.report", "Analysis": "plans.report", "render_json": "plans.report", "render_html": "plans.report", "render_text": "plans.report",
    "AnalyzeOptions": "options", "RedactionConfig": "options", "RedactionPattern": "options", "UsageError": "options", "parse_duration": "options", "parse_byte_size": "options",
    "read_lines": "sources.lines", "lines_from": "sources.lines", "demo_lines": "sources.lines", "load_redaction_config": "sources.lines",
    "parse": "operators.parse", "parse_line": "operators.parse", "parse_logfmt": "operators.parse", "Redactor": "operators.redact", "redact": "operators.redact",
    "TemplateMiner": "operators.templates", "assign_templates": "operators.templates", "detect": "operators.anomalies", "leave_one_out": "operators.anomalies",
    "find_precursors": "operators.precursors", "next_failures": "operators.precursors", "normalize_level": "functions.normalise", "parse_timestamp": "functions.normalise",
    "parse_latency": "functions.normalise", "clamp": "functions.scalars", "stable_id": "functions.scalars",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_PLACES[name]}", __name__), name)
