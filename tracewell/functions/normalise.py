"""Normalisers of levels, timestamps and latencies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import SPACES, trim

#: Names of levels and what they count as.
LEVELS = {
    "trace": "trace", "verbose": "trace", "debug": "debug", "info": "info", "notice": "info", "warn": "warn", "warning": "warn",
    "error": "error", "err": "error", "fatal": "fatal", "critical": "fatal", "crit": "fatal", "emergency": "fatal", "emerg": "fatal", "alert": "fatal",
}
#: Numeric levels from which a level holds.
LEVEL_STEPS = ((60, "fatal"), (50, "error"), (40, "warn"), (30, "info"), (20, "debug"), (10, "trace"))
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_NUMBER = r"^\d+(?:\.\d+)?$"


def level_of_number(number: Column) -> Column:
    """Thresholds of 10 to 60; smaller and negative numbers are unknown."""
    out = F.lit("unknown")
    for step, name in reversed(LEVEL_STEPS):
        out = F.when(number >= step, name).otherwise(out)
    return out


def normalize_level(text: Column) -> Column:
    """Level of a textual level or number; null and unheard-of names are unknown."""
    low = F.lower(trim(text))
    names = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    named = F.coalesce(F.element_at(names, low), F.lit("unknown"))
    return F.when(text.isNull(), "unknown").when(low.rlike(_NUMBER), level_of_number(low.try_cast("double"))).otherwise(named)


def millis_of_number(number: Column) -> Column:
    """Epoch seconds below 1e10, else milliseconds; null beyond the range of dates."""
    ms = F.when(number < 1e10, number * 1000).otherwise(number)
    whole = F.when(ms < 0, F.ceil(ms)).otherwise(F.floor(ms))
    return F.when(F.abs(ms) <= 8.64e15, whole.cast("long"))


def parse_timestamp(text: Column, year: int) -> Column:
    """Epoch milliseconds of ISO forms (zone optional, UTC without), syslog stamps of ``year``,
    epoch seconds or milliseconds in digits, and RFC 2822 dates; null otherwise."""
    t = F.regexp_replace(trim(text), r"^\[|\]$", "")
    digits = t.rlike(r"^(\d{10}(?:\.\d+)?|\d{13})$")
    syslog = rf"^(?i)({_MONTHS})\s+(\d{{1,2}})\s+(\d{{2}}:\d{{2}}:\d{{2}})$"
    month = F.initcap(F.lower(F.regexp_extract(t, syslog, 1)))
    stamp = F.concat_ws(" ", month, F.regexp_extract(t, syslog, 2), F.lit(str(year)), F.regexp_extract(t, syslog, 3))
    mail = rf"^(?i)(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+)?(\d{{1,2}})\s+({_MONTHS})\s+(\d{{4}})\s+(\d{{2}}:\d{{2}}:\d{{2}})\s*(GMT|UTC|[+-]\d{{4}})?$"
    zone = F.regexp_extract(t, mail, 5)
    zone = F.when(zone.rlike("^[+-]"), zone).otherwise("+0000")
    letter = F.concat_ws(" ", F.initcap(F.lower(F.regexp_extract(t, mail, 2))), F.regexp_extract(t, mail, 1), F.regexp_extract(t, mail, 3), F.regexp_extract(t, mail, 4), zone)
    iso = F.when(t.rlike(r"^[+-]?\d{4,6}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{1,2}.*)?)?)?$"), F.unix_millis(t.try_cast("timestamp")))
    return (
        F.when(digits, millis_of_number(t.try_cast("double")))
        .when(t.rlike(syslog), F.unix_millis(F.try_to_timestamp(stamp, F.lit("MMM d yyyy HH:mm:ss"))))
        .when(t.rlike(mail), F.unix_millis(F.try_to_timestamp(letter, F.lit("MMM d yyyy HH:mm:ss Z"))))
        .otherwise(iso)
    )


def parse_latency(text: Column, key: Column | str = "") -> Column:
    """Milliseconds of a number with an optional unit; without one, seconds if the key ends in
    ``_s``, else milliseconds. Null if the text is no latency."""
    shape = rf"^(?i){SPACES}*(\d+(?:\.\d+)?){SPACES}*(ns|us|µs|μs|ms|s|sec|secs|seconds)?{SPACES}*$"
    amount = F.regexp_extract(text, shape, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, shape, 2))
    key = F.lit(key) if isinstance(key, str) else key
    plain = F.when(F.lower(key).endswith("_s"), "s").otherwise("ms")
    unit = F.when(unit == "", plain).otherwise(unit)
    # division keeps more digits than a factor below one
    per = F.when(unit == "ns", amount / 1e6).when(unit.isin("us", "µs", "μs"), amount / 1e3).when(unit == "ms", amount).otherwise(amount * 1e3)
    return F.when(text.rlike(shape) & (per < float("inf")), per)
