"""Failure precursors: a forward as-of join and association rules over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import percent, round_half
from .aggregate import quantile_of

WINDOW_MS = 300_000
MIN_SUPPORT, MIN_LIFT = 2, 1.25


def sequence(assigned: DataFrame, max_events: int | None = None) -> DataFrame:
    """seq, ts_ms, service, template_id, failure of events with a time: all of them, or the first
    ``max_events`` by arrival."""
    df = assigned.filter(F.col("ts_ms").isNotNull()).select("seq", "ts_ms", "service", "template_id", F.col("level").isin("error", "fatal").alias("failure"))
    return df if max_events is None else df.orderBy("seq").limit(max_events)


def next_failures(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Non-failures with the nearest later failure of their service, by time, then arrival.

    The failure is null unless its gap is above 0 and at most ``window_ms``; one at the same
    time that arrived later hides later ones. Services are dealt to blocks of ``window_ms``:
    what a block lacks can only be the next block's first failure, so a busy service is
    spread over tasks.
    """
    df = events.withColumn("_b", F.floor(F.col("ts_ms") / window_ms).cast("long"))
    mark = F.when(F.col("failure"), F.struct("ts_ms", "seq", "template_id"))
    heads = df.groupBy("service", "_b").agg(F.min(mark).alias("_head")).filter("_head is not null").select("service", (F.col("_b") - 1).alias("_b"), "_head")
    ahead = Window.partitionBy("service", "_b").orderBy("ts_ms", "seq").rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("_own", F.first(mark, ignorenulls=True).over(ahead)).filter(~F.col("failure"))
    df = df.join(heads, ["service", "_b"], "left").withColumn("_f", F.coalesce("_own", "_head"))
    gap = F.col("_f.ts_ms") - F.col("ts_ms")
    near = (gap > 0) & (gap <= window_ms)
    return df.select("seq", "ts_ms", "service", "template_id", F.when(near, F.col("_f.template_id")).alias("failure_template_id"), F.when(near, gap).alias("gap_ms"))


def find_precursors(events: DataFrame, templates: DataFrame | None = None, window_ms: int = WINDOW_MS, min_support: int = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> DataFrame:
    """Templates that precede failures more often than chance, by service: temporal
    associations, no causes. ``templates`` has template_id and template texts."""
    linked = next_failures(events, window_ms)
    pair = ["service", "template_id", "failure_template_id"]
    pairs = quantile_of(linked.groupBy(*pair, "gap_ms").agg(F.count("*").alias("_c")), pair, "gap_ms", 0.5, "gap", F.sum("_c").alias("n"))
    source = Window.partitionBy("service", "template_id")
    failing = Window.partitionBy("service", "failure_template_id")
    pairs = pairs.select("*", F.sum("n").over(source).alias("occurrences"), F.sum("n").over(failing).alias("baseline"), F.sum("n").over(Window.partitionBy("service")).alias("events"))
    lift = (F.col("n") / F.col("occurrences")) / (F.col("baseline") / F.col("events"))
    rules = pairs.filter(F.col("failure_template_id").isNotNull() & (F.col("n") >= min_support)).withColumn("_lift", lift).filter(F.col("_lift") >= min_lift)
    out = rules.select(
        "service", F.col("template_id").alias("source_template_id"), "failure_template_id", "occurrences", F.col("n").alias("support"),
        percent(F.col("n"), F.col("occurrences")).alias("support_percent"), round_half(F.col("_lift"), 3).alias("lift"), round_half(F.col("gap"), 3).alias("median_gap_ms"),
    )
    for side in ("source", "failure"):
        key = f"{side}_template_id"
        if templates is None:
            out = out.withColumn(f"{side}_template", F.col(key))
        else:
            text = templates.select(F.col("template_id").alias(key), F.col("template").alias("_text"))
            out = out.join(text, key, "left").withColumn(f"{side}_template", F.coalesce("_text", key)).drop("_text")
    return out.orderBy(F.desc("support"), F.desc("lift"), F.desc("support_percent"), "service", "source_template_id", "failure_template_id")
