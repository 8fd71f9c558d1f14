"""Command line: ``python -m tracewell.cli [analyze] [FILE] [options]`` or ``demo``."""

from __future__ import annotations

import argparse
import os
import sys
import webbrowser
from datetime import datetime, timezone

from .options import VERSION, AnalyzeOptions, UsageError, parse_byte_size, parse_duration

EXIT_OK, EXIT_ANOMALY, EXIT_ERROR = 0, 1, 2


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def _arguments() -> argparse.ArgumentParser:
    p = _Parser(prog="tracewell", description="Find out what is going on in logs: NDJSON, logfmt or plain text, gzip too.", allow_abbrev=False)
    p.add_argument("input", nargs="*", help="log file, folder or glob; - or nothing reads standard input")
    p.add_argument("--json", metavar="PATH", help="write the report as JSON (- for standard output)")
    p.add_argument("--html", metavar="PATH", help="write the report as one HTML page (- for standard output)")
    p.add_argument("--format", choices=("summary", "json", "html"), default="summary", help="what goes to standard output")
    p.add_argument("--bucket", default="1m", help="width of a time bucket, such as 30s, 5m, 1h")
    p.add_argument("--precursors", action="store_true", help="look for templates that precede failures")
    p.add_argument("--sequence-window", help="longest gap to a failure (with --precursors)")
    p.add_argument("--top", type=int, default=10, help="templates in the summary, 1 to 1000")
    p.add_argument("--max-line-length", default="2mb", help="bytes of a line that are kept, 1kb to 1gb")
    p.add_argument("--redaction-config", "--config", dest="config", metavar="PATH", help="JSON file with further fields and patterns")
    p.add_argument("--no-redact", action="store_true", help="keep personal data and secrets")
    p.add_argument("--open", action="store_true", help="open the HTML page")
    p.add_argument("--fail-on-anomaly", action="store_true", help="exit with 1 if there are anomalies")
    p.add_argument("-q", "--quiet", action="store_true", help="no summary and no messages")
    p.add_argument("--demo", action="store_true", help="analyse a built-in incident")
    p.add_argument("-v", "--version", action="store_true", help="print the version")
    return p


def parse_arguments(argv: list[str]) -> argparse.Namespace:
    argv = list(argv)
    demo = argv[:1] == ["demo"]
    if argv[:1] in (["demo"], ["analyze"]):
        argv = argv[1:]
    a = _arguments().parse_args(argv)
    a.demo = a.demo or demo
    if len(a.input) > 1:
        raise UsageError("Provide at most one input file")
    if a.demo and a.input:
        raise UsageError("The demo has data of its own and takes no input file")
    a.input = a.input[0] if a.input else None
    a.bucket_ms = parse_duration(a.bucket)
    if a.bucket_ms < 1000:
        raise UsageError("--bucket must be at least 1s")
    if a.sequence_window is not None and not a.precursors:
        raise UsageError("--sequence-window requires --precursors")
    a.window_ms = parse_duration(a.sequence_window or "5m")
    if a.window_ms != int(a.window_ms) or a.window_ms < 1:
        raise UsageError("--sequence-window must be at least 1ms")
    if not 1 <= a.top <= 1000:
        raise UsageError("--top must be an integer from 1 to 1000")
    a.max_bytes = parse_byte_size(a.max_line_length)
    if (a.json == "-") + (a.html == "-") + (a.format != "summary") > 1:
        raise UsageError("Only one JSON or HTML output may go to standard output")
    if a.json and a.json == a.html and a.json != "-":
        raise UsageError("--json and --html must use different paths")
    if a.open and a.html in (None, "-"):
        raise UsageError("--open requires --html PATH")
    return a


def run(argv: list[str] | None = None, spark=None) -> int:
    """Exit code: 0; 1 with --fail-on-anomaly if there are any; 2 on any error."""
    try:
        a = parse_arguments(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        print(f"tracewell: {e}\nTry --help.", file=sys.stderr)
        return EXIT_ERROR
    if a.version:
        print(VERSION)
        return EXIT_OK
    from_stdin = not a.demo and a.input in (None, "-")
    if from_stdin and a.input is None and sys.stdin.isatty():
        print("tracewell: name a log file or pipe logs to standard input\nTry --help.", file=sys.stderr)
        return EXIT_ERROR
    try:
        return _analyse(a, spark, from_stdin)
    except BrokenPipeError:
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        return EXIT_OK
    except Exception as e:
        print(f"tracewell: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return EXIT_ERROR


def _analyse(a: argparse.Namespace, spark, from_stdin: bool) -> int:
    from .plans.report import analyze, render_html, render_json, render_text, write_atomic
    from .session import get_spark
    from .sources.lines import DEMO_SOURCE, demo_lines, load_redaction_config, read_lines, stdin_lines

    config = load_redaction_config(a.config)
    spark = spark or get_spark()
    if a.demo:
        lines, source = demo_lines(spark), DEMO_SOURCE
    elif from_stdin:
        lines, source = stdin_lines(spark, a.max_bytes), "stdin"
    else:
        lines, source = read_lines(spark, a.input, a.max_bytes), a.input
    options = AnalyzeOptions(
        source=source, bucket_ms=a.bucket_ms, redact=not a.no_redact, redaction=config, max_line_length=a.max_bytes,
        precursors=a.precursors, sequence_window_ms=int(a.window_ms), now=datetime.now(timezone.utc),
    )
    analysis = analyze(spark, lines, options)
    doc = analysis.to_dict()
    analysis.release()
    for path, render, kind in ((a.json, render_json, "JSON"), (a.html, render_html, "HTML")):
        if path == "-":
            sys.stdout.write(render(doc))
        elif path:
            write_atomic(path, render(doc))
            if not a.quiet:
                print(f"{kind} report: {path}", file=sys.stderr)
    if a.open:
        webbrowser.open("file://" + os.path.abspath(a.html))
    if a.format != "summary":
        sys.stdout.write(render_json(doc) if a.format == "json" else render_html(doc))
    elif not a.quiet and "-" not in (a.json, a.html):
        sys.stdout.write(render_text(doc, a.top))
    sys.stdout.flush()
    return EXIT_ANOMALY if a.fail_on_anomaly and doc["anomalies"] else EXIT_OK


if __name__ == "__main__":
    sys.exit(run())
