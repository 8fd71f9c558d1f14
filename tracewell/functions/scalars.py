"""Scalar functions: rounding, percentages, ids, times and durations, as columns and in Python."""

from __future__ import annotations

import functools
import hashlib
import math

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

EPSILON = 2.0**-52
MAX_SAFE_INTEGER = 2**53 - 1
#: White space as trimmed from lines: ASCII and Unicode spaces, and the byte order mark.
SPACES = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NOT_SPACES = SPACES.replace("[", "[^", 1)
#: Word edges of ASCII words, whatever stands beside them.
EDGE_BEFORE = "(?<![A-Za-z0-9_])"


def cached(build):
    """Keep the columns that ``build`` makes of its arguments: they name no DataFrame, and making
    a long expression takes thousands of calls into the JVM."""
    made: dict = {}

    @functools.wraps(build)
    def get(*args):
        jvm = SparkContext._gateway
        if args not in made or made[args][0] is not jvm:
            made[args] = (jvm, build(*args))
        return made[args][1]

    return get


def round_half(value: Column, places: int = 2) -> Column:
    """Half up after adding 2^-52; values too large for it stay as they are."""
    f = float(10**places)
    return F.when(F.abs(value) > MAX_SAFE_INTEGER / f, value).otherwise(F.floor((value + EPSILON) * f + 0.5) / f)


def round_half_py(value: float, places: int = 2) -> float:
    f = 10.0**places
    if not math.isfinite(value) or abs(value) > MAX_SAFE_INTEGER / f:
        return value
    return math.floor((value + EPSILON) * f + 0.5) / f


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(round_half(part / total * 100, 2))


def percent_py(part: float, total: float) -> float:
    return 0.0 if not total else round_half_py(part / total * 100, 2)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def stable_id(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, 10))


def stable_id_py(text: str, prefix: str = "") -> str:
    return prefix + hashlib.sha1(text.encode()).hexdigest()[:10]


def iso_ms(ms: Column) -> Column:
    """ISO 8601 with milliseconds in UTC, whatever the session's time zone."""
    whole, rest = F.floor(ms / 1000).cast("long"), F.pmod(ms, F.lit(1000))
    days, seconds = F.floor(whole / 86400).cast("int"), F.pmod(whole, F.lit(86400))
    clock = F.concat_ws(":", *[F.lpad(x.cast("long").cast("string"), 2, "0") for x in (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)])
    date = F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
    return F.when(ms.isNotNull(), F.concat(date, F.lit("T"), clock, F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("Z")))


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACES}+", ""), f"{SPACES}+$", "")


def bucket_of(ms: Column, bucket_ms: int) -> Column:
    """Start of the tumbling bucket, counted from the epoch."""
    return (F.floor(ms / bucket_ms) * bucket_ms).cast("long")


def format_duration(ms: float) -> str:
    for limit, unit, size in ((1_000, "ms", 1), (60_000, "s", 1_000), (3_600_000, "m", 60_000), (math.inf, "h", 3_600_000)):
        if ms < limit:
            return f"{number_text(round_half_py(ms / size, 3 if ms < 1 else 1))}{unit}"
    raise ValueError(ms)


def number_text(value: float) -> str:
    """Shortest form, whole numbers without a point."""
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e15 else repr(float(value))


def isolate(df: DataFrame) -> DataFrame:
    """``df`` as it is, with predicates above kept above: pushing one through a long chain of
    projections would copy the chain's expressions many times over."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
