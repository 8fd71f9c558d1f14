"""Shared helpers: tables, size-checked broadcasts, even buckets, connected components."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..storage import materialise, release, scratch  # noqa: F401

#: Word pattern of every contract: runs of anything but space, tab and the line controls.
WORD = r"[^\x20\x09-\x0D]+"
#: The same separators, as a Java character class.
SEPARATOR = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of whole texts that Spark hands to a Python worker at once.
BATCH_ROWS = 500


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, texts reach Python workers in small batches: at the default of 10000 rows every
    worker holds, and keeps, hundreds of MB. The caller's setting is put back at the end, so
    what reads texts in Python has to run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_on_texts(df: DataFrame) -> DataFrame:
    """``materialise`` of a Python stage over whole texts."""
    with small_batches(df.sparkSession):
        return materialise(df)


def whole_rows(docs: DataFrame) -> Column:
    """The input row as one struct, so that no column of its own can clash with an internal one."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast only when the counted rows (narrow ids) are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def bounds_of(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 bounds that cut a column of longs into parts of about equal rows,
    ascending; a value that fills several parts is there several times. Nulls don't count."""
    if parts < 2:
        return []
    cuts = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    got = df.agg(F.percentile_approx(column, cuts, F.lit(10_000)).alias("b")).first()["b"]
    return [int(b) for b in got or []]


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, found by halving; null of null."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
    find = F.aggregate(steps, F.lit(0), lambda n, b: F.when(F.coalesce(F.get(known, n + b - 1) <= value, F.lit(False)), n + b).otherwise(n))
    return F.when(value.isNotNull(), find)


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a partition as stars around its smallest vertices, a bounded number at a time."""
    for pdf in batches:
        who, at = np.unique(np.r_[pdf["u"].to_numpy(), pdf["v"].to_numpy()], return_inverse=True)
        x, y, label = at[: len(pdf)], at[len(pdf) :], np.arange(len(who))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(who)))
        yield pd.DataFrame({"u": who[own], "v": who[label[own]]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list ``(a, b)``.

    Returns ``(id, component)`` for every vertex on an edge, component being the smallest
    vertex reachable. Alternating large-star and small-star rounds, until one changes
    nothing: every round hangs neighbours below the smallest neighbour, so the number of
    rounds is logarithmic in the longest path, and each round's edges never outnumber the
    first's. Before them, edges that lie in one batch become stars, which shortens paths. A
    hub is met by partial aggregation and a join whose large partitions adaptive execution
    splits. Null or self edges are ignored.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.filter("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e.mapInPandas(_contracted, "u long, v long"))
    last, mark = None, {}
    while mark != last:
        last = mark
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        seen = Observation()
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        nxt = materialise(small.filter("u > v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("d")))
        mark = seen.get
        release(e)
        e = nxt
    leaves = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return leaves.union(roots.join(leaves.select("id"), "id", "left_anti"))
