"""Counts, latency summaries, fallback times and the timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import bucket_of, iso_ms, percent, round_half
from ..storage import materialise

#: Arrival numbers that share a chunk of the carry-forward.
CHUNK_BITS = 16


def counts_by(events: DataFrame, column: str) -> DataFrame:
    """name, count, percent; most frequent first, then by name."""
    per = events.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"))
    total = per.agg(F.sum("count").alias("_t"))
    out = per.crossJoin(F.broadcast(total)).select("name", "count", percent(F.col("count"), F.col("_t")).alias("percent"))
    return out.orderBy(F.desc("count"), "name")


def ranged_counts(df: DataFrame, value: str) -> DataFrame:
    """_v, _c, _p: distinct values, how often each occurs, and its range. Ranges are in order and
    of about one size; the table is written, so that every reader sees the same ranges."""
    per = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(per.repartitionByRange(ranges, "_v").select("_v", "_c", F.spark_partition_id().alias("_p")))


def quantiles(per: DataFrame, qs: list[float]) -> DataFrame:
    """One row q0, q1, ...: exact interpolated quantiles of ``ranged_counts``. Ranges are counted
    first; only those that hold a wanted place are ordered, each in a task that can spill."""
    ranges = per.groupBy("_p").agg(F.sum("_c").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_p", "_n", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    at = [(F.col("_all") - 1) * F.lit(q) for q in qs]
    places = [place for a in at for place in (F.floor(a), F.ceil(a))]
    held = [(p >= F.col("_before")) & (p < F.col("_before") + F.col("_n")) for p in places]
    # one row a range: as many as there are shuffle partitions
    rows = per.join(F.broadcast(ranges.filter(reduce(Column.__or__, held))), "_p")
    to = F.col("_before") + F.sum("_c").over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = [F.min(F.when(F.col("_to") > p, F.col("_v"))).alias(f"_{k}") for k, p in enumerate(places)]
    one = rows.withColumn("_to", to).agg(F.max("_all").alias("_all"), *found)
    return one.select(*[(F.col(f"_{2 * k}") + (F.col(f"_{2 * k + 1}") - F.col(f"_{2 * k}")) * (a - F.floor(a))).alias(f"q{k}") for k, a in enumerate(at)])


def latency_summary(events: DataFrame) -> DataFrame:
    """One row: count, min, max, mean and exact interpolated quantiles of latencies, rounded to
    3 places. ``approximate`` is always false: quantiles spill instead of being sampled. The
    mean is scaled by a power of two, which is exact, so that no sum overflows."""
    per = ranged_counts(events, "duration_ms")
    r = lambda c: round_half(c, 3)
    count = F.coalesce(F.sum("_c"), F.lit(0))
    mean = F.sum(F.col("_v") / 2.0**64 * F.col("_c")) / F.sum("_c") * 2.0**64
    one = per.agg(count.alias("count"), r(F.min("_v")).alias("min_ms"), r(F.max("_v")).alias("max_ms"), r(mean).alias("mean_ms"))
    one = one.crossJoin(quantiles(per, [0.5, 0.95, 0.99]))
    return one.select("count", "min_ms", "max_ms", "mean_ms", *[r(F.col(f"q{k}")).alias(f"p{p}_ms") for k, p in enumerate((50, 95, 99))], F.lit(False).alias("approximate"))


def summary(events: DataFrame) -> DataFrame:
    """One row of totals over canonical events."""
    return events.agg(
        F.count("*").alias("events"), F.count_if("malformed").alias("malformed"), F.count_if(F.col("level").isin("error", "fatal")).alias("errors"),
        F.count_if(F.col("level") == "warn").alias("warnings"), F.count_if(F.col("ts_ms").isNull()).alias("missing_timestamps"),
        F.count_distinct("service").alias("services"), F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"),
    ).withColumn("error_rate", percent(F.col("errors"), F.col("events")))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.count_if("truncated").alias("truncated"))


def carry_forward(events: DataFrame, start_ms: int) -> DataFrame:
    """``events`` with event_ms: the own time, or the latest known one by arrival, or
    ``start_ms`` before any is known.

    Two phases: within chunks of arrival numbers, then over the chunks' last times; no task
    sees all events.
    """
    df = events.withColumn("_c", F.shiftright("seq", CHUNK_BITS))
    back = Window.partitionBy("_c").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = df.groupBy("_c").agg(F.max_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("seq"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_c", before.alias("_before"))
    df = df.withColumn("_own", F.last("ts_ms", ignorenulls=True).over(back)).join(ends, "_c")
    return df.withColumn("event_ms", F.coalesce("_own", "_before", F.lit(start_ms))).drop("_c", "_own", "_before")


def with_event_time(events: DataFrame, start_ms: int, missing: bool = True) -> DataFrame:
    """``carry_forward`` where times are missing; else the times themselves, without a shuffle."""
    return carry_forward(events, start_ms) if missing else events.withColumn("event_ms", F.col("ts_ms"))


def quantile_of(per: DataFrame, keys: list[str], value: str, q: float, out: str, *more: Column) -> DataFrame:
    """Interpolated quantile of ``value`` by ``keys``: below + (above - below) * fraction; and
    ``more`` aggregates by ``keys``. ``per`` has a row for each distinct value of a group, null
    among them, with ``_c``, how often it occurs: what a group brings to one task are its
    distinct values, which can spill."""
    known = F.when(F.col(value).isNotNull(), F.col("_c"))
    group = Window.partitionBy(*keys)
    to = F.sum(known).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = per.withColumn("_to", to).withColumn("_at", (F.sum(known).over(group) - 1) * F.lit(q))
    at = lambda place: F.min(F.when(F.col("_to") > place, F.col(value)))
    per = per.groupBy(*keys).agg(at(F.floor("_at")).alias("_lo"), at(F.ceil("_at")).alias("_hi"), F.first(F.col("_at") - F.floor("_at")).alias("_f"), *more)
    kept = [c for c in per.columns if c not in ("_lo", "_hi", "_f")]
    return per.select(*kept, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))


def timeline(events: DataFrame, bucket_ms: int) -> DataFrame:
    """bucket_ms, count, errors, error_rate, latency_p95_ms by tumbling bucket of event_ms, in order."""
    rows = events.select(bucket_of(F.col("event_ms"), bucket_ms).alias("bucket_ms"), F.col("level").isin("error", "fatal").cast("int").alias("_bad"), "duration_ms")
    # counts go with the distinct latencies, so that the events are read and dealt once
    per = rows.groupBy("bucket_ms", "duration_ms").agg(F.count("*").alias("_c"), F.sum("_bad").alias("_e"))
    per = quantile_of(per, ["bucket_ms"], "duration_ms", 0.95, "p", F.sum("_c").alias("count"), F.coalesce(F.sum("_e"), F.lit(0)).alias("errors"))
    return per.select("bucket_ms", iso_ms(F.col("bucket_ms")).alias("timestamp"), "count", "errors", percent(F.col("errors"), F.col("count")).alias("error_rate"), round_half(F.col("p"), 3).alias("latency_p95_ms")).orderBy("bucket_ms")
