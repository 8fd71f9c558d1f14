"""Text features and labels that the trained classifiers share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of labelled training data at most, picked by a hash of doc_id. A documented bound:
#: what is learnt is a few dozen to a few thousand weights.
MAX_TRAIN = 20_000


def fold_of(doc_id):
    """crc32 of doc_id as text, mod 3; rows of fold 1 are held out of all training."""
    return F.crc32(doc_id.cast("string")) % 3


def training_ids(labels: DataFrame, label: str, max_rows: int = MAX_TRAIN, largest: int = 1) -> DataFrame:
    """At most ``max_rows`` ids outside the held-out fold, with labels of 0 to ``largest``.

    Null ids or labels and other labels are passed over; an id labelled twice
    counts once, with the larger label. The pick is by hash, so reruns agree.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").between(0, largest) & (fold_of(F.col("doc_id")) != 1))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
