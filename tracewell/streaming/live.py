"""Structured Streaming forms: events, timeline and templates of lines as they arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.scalars import percent, round_half
from ..operators.parse import parse
from ..operators.redact import Redactor, redact
from ..operators.templates import THRESHOLD, TemplateMiner, tokens_of
from ..sources.lines import bound


def stream_lines(spark: SparkSession, path: str, max_bytes: int = 2_000_000) -> DataFrame:
    """Lines of files that appear in a folder, each file read whole (so files should be small,
    as rotated logs are). ``seq`` is a struct in order of arrival: the file's time, its path and
    the line's place, so files of one time do not mix and a file may have any number of lines."""
    raw = spark.readStream.text(path, wholetext=True).filter("value <> ''")  # an empty file has no line
    body = F.regexp_replace("value", "\n\\z", "")
    at = F.unix_millis("_metadata.file_modification_time").alias("_t"), F.col("_metadata.file_path").alias("_f")
    rows = raw.select(*at, F.posexplode(F.split(body, "\n")).alias("_k", "_x"))
    seq = F.struct(F.col("_t").alias("time_ms"), F.col("_f").alias("file"), F.col("_k").alias("place"))
    return bound(rows.select(seq.alias("seq"), F.regexp_replace("_x", "\r\\z", "").alias("text"), F.lit(False).alias("truncated")), max_bytes)


def stream_events(lines: DataFrame, year: int, redactor: Redactor | None = None) -> DataFrame:
    """Redacted canonical events with ``ts``, a timestamp column for watermarks."""
    return redact(parse(lines, year), redactor).withColumn("ts", F.timestamp_millis("ts_ms"))


def stream_timeline(events: DataFrame, bucket: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """The timeline by tumbling bucket; a bucket is final once the watermark has passed it.
    Events without a time have no place in it; those later than ``delay`` are left out."""
    d = F.col("duration_ms")
    per = events.filter("ts is not null").withWatermark("ts", delay).groupBy(F.window("ts", bucket).alias("w")).agg(
        F.count("*").alias("count"), F.count_if(F.col("level").isin("error", "fatal")).alias("errors"), F.percentile(d, F.lit(0.95)).alias("p"),
    )
    return per.select(F.unix_millis("w.start").alias("bucket_ms"), "count", "errors", percent(F.col("errors"), F.col("count")).alias("error_rate"), round_half(F.col("p"), 3).alias("latency_p95_ms"))


def stream_templates(events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Templates as they stand after each micro-batch: n_tokens, template_id, template, count.

    The clusters of each token count are kept as state, one entry a cluster; a micro-batch's
    events enter in order of arrival.
    """
    kind = events.schema["seq"].dataType
    parts = [F.col("seq")[n] for n in kind.names] if isinstance(kind, StructType) else [F.col("seq")]
    order = [f"_{k}" for k in range(len(parts))]

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        miner = TemplateMiner(key[0], threshold)
        counts: list[int] = []
        if state.exists:
            for first, row, n in json.loads(state.get[0]):
                k = len(miner.firsts)
                miner.rows = miner._room(miner.rows, k)
                miner.rows[k] = [miner.code.setdefault(t, len(miner.code)) for t in row]
                miner.firsts.append(first)
                counts.append(n)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        for tokens in rows["tokens"]:
            miner.add(0, json.loads(tokens))
            k = miner.moves[-1][2] if len(miner.moves) == 1 else next(m[2] for m in reversed(miner.moves) if m[0] == len(miner.owner) - 1)
            counts += [0] * (k + 1 - len(counts))
            counts[k] += 1
            miner.owner, miner.moves = [], []
        names = {v: t for t, v in miner.code.items()}
        state.update((json.dumps([[miner.firsts[k], [names[c] for c in miner.rows[k].tolist()], counts[k]] for k in range(len(counts))]),))
        named = [miner.template(k) for k in range(len(counts))]
        yield pd.DataFrame({"n_tokens": key[0], "template_id": [t[0] for t in named], "template": [t[1] for t in named], "count": counts})

    listed = events.select(*[c.alias(n) for c, n in zip(parts, order)], tokens_of(F.col("message")).alias("_t")).select(*order, F.size("_t").alias("n_tokens"), F.to_json("_t").alias("tokens"))
    return listed.groupBy("n_tokens").applyInPandasWithState(
        update, "n_tokens int, template_id string, template string, count long", "clusters string", "update", GroupStateTimeout.NoTimeout
    )
