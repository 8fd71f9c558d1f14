"""Options of an analysis and the parsers of their textual forms."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

VERSION = "0.1.0"
MAX_SAFE_INTEGER = 2**53 - 1


class UsageError(ValueError):
    """An option that a user has to change."""


@dataclass
class RedactionPattern:
    name: str
    regex: str
    flags: str = "g"
    replacement: str | None = None


@dataclass
class RedactionConfig:
    sensitive_fields: list[str] = field(default_factory=list)
    patterns: list[RedactionPattern] = field(default_factory=list)
    enabled: bool | None = None

    @classmethod
    def from_dict(cls, data: dict) -> RedactionConfig:
        if not isinstance(data, dict):
            raise UsageError("Redaction config must be a JSON object")
        patterns = [RedactionPattern(p["name"], p["regex"], p.get("flags") or "g", p.get("replacement")) for p in data.get("patterns") or []]
        return cls(list(data.get("sensitiveFields") or []), patterns, data.get("enabled"))


@dataclass
class AnalyzeOptions:
    source: str = "stdin"
    bucket_ms: int = 60_000
    redact: bool = True
    redaction: RedactionConfig = field(default_factory=RedactionConfig)
    max_line_length: int = 2_000_000
    max_samples: int = 3
    precursors: bool = False
    sequence_window_ms: int = 300_000
    #: Events that take part in the precursor analysis, the first by arrival; None: all.
    max_sequence_events: int | None = None
    #: Stands for the wall clock: fallback time, and the year of stamps without one.
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def validate(self) -> AnalyzeOptions:
        if int(self.bucket_ms) != self.bucket_ms or self.bucket_ms < 1000:
            raise UsageError("bucket_ms must be a whole number of at least 1000")
        if not 1 <= self.max_line_length <= MAX_SAFE_INTEGER:
            raise UsageError("max_line_length must be a positive safe integer")
        if self.precursors:
            for name in ("sequence_window_ms", "max_sequence_events"):
                value = getattr(self, name)
                if value is None and name == "max_sequence_events":
                    continue
                if int(value) != value or not 1 <= value <= MAX_SAFE_INTEGER:
                    raise UsageError(f"{name} must be a positive safe integer")
        self.bucket_ms = int(self.bucket_ms)
        return self

    @property
    def redaction_enabled(self) -> bool:
        """A config that says so overrides the switch."""
        return self.redact if self.redaction.enabled is None else self.redaction.enabled

    @property
    def now_ms(self) -> int:
        return int(self.now.timestamp() * 1000)


def parse_duration(text: str) -> float:
    """Milliseconds of ``250ms``, ``5s``, ``1.5m``, ``1h``; a bare number is milliseconds."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s|m|h)?", text.strip(), re.I | re.A)
    if not m:
        raise UsageError(f"Invalid duration: {text}")
    value = float(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[(m[2] or "ms").lower()]
    return int(value) if value == int(value) else value


def parse_byte_size(text: str) -> int:
    """Bytes of ``64kb``, ``2mb``, ``1gb`` (powers of 1024), from 1 kb to 1 gb."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(b|kb|mb|gb)?", text.strip(), re.I | re.A)
    if not m:
        raise UsageError(f"Invalid byte size: {text}")
    size = int(float(m[1]) * 1024 ** ["b", "kb", "mb", "gb"].index((m[2] or "b").lower()))
    if not 1024 <= size <= 1024**3:
        raise UsageError("--max-line-length must be between 1kb and 1gb")
    return size
