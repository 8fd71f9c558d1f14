"""Template mining: tokens, their classes, and the ordered clustering of token lists."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import NOT_SPACES, cached, percent, trim

WILDCARD = "<*>"
THRESHOLD = 0.6
MAX_TEXT = 500
#: Fixed value: what counts as one token.
_TOKEN = rf"\[[^\]]+\]|\"(?:\\.|[^\"\\])*\"|'[^']*'|{NOT_SPACES}+"
#: What a token of a shape stands for, the first that fits.
SHAPES = (
    (r"(?i)^\[REDACTED:[A-Z0-9_-]+\][,;:.]?$", "<redacted>"),
    (r"(?i)^(?:https?|wss?)://", "<url>"),
    (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}[,;:.]?$", "<uuid>"),
    (r"(?i)^(?:0x)?[0-9a-f]{10,}[,;:.]?$", "<hex>"),
    (r"(?i)^[+-]?\d+(?:\.\d+)?(?:ms|s|m|h|kb|mb|gb|%)?[,;:.]?$", "<num>"),
    (r"^(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?[,;:.]?$", "<ip>"),
    (r"^/[A-Za-z0-9_./-]{4,}[,;:.]?$", "<path>"),
)


def normalize_token(token: Column) -> Column:
    out = F.when((F.char_length(token) > 96) & token.rlike(r"^[A-Za-z0-9+/_=-]+$"), "<blob>").otherwise(token)
    for shape, name in reversed(SHAPES):
        out = F.when(token.rlike(shape), name).otherwise(out)
    return out


def tokens_of(message: Column) -> Column:
    """Classified tokens: bracketed groups, quoted strings and words; one for an empty message."""
    found = F.regexp_extract_all(trim(message), F.lit(_TOKEN), F.lit(0))
    return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("(empty message)"))), normalize_token)


@cached
def _message_tokens() -> Column:
    return tokens_of(F.col("message"))


class TemplateMiner:
    """Clusters of token lists of one length, fed in order of first arrival.

    A list seen before is alike in full to the cluster that took it, so it changes no
    cluster: only first arrivals do. A cluster that grew more general later takes over lists
    of later-made clusters that it now fits; from then on they are its own.
    """

    def __init__(self, width: int, threshold: float):
        self.threshold = threshold
        self.code: dict[str, int] = {WILDCARD: 0}
        self.rows = np.zeros((16, width), np.int64)
        self.firsts: list[list[str]] = []
        self.lists = np.zeros((16, width), np.int64)
        self.owner: list[int] = []
        self.moves: list[tuple[int, int, int]] = []  # list, since, cluster

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n < len(a) else np.vstack([a, np.zeros_like(a)])

    def add(self, seq: int, tokens: list[str]) -> None:
        x = np.array([self.code.setdefault(t, len(self.code)) for t in tokens])
        n, best = len(self.firsts), -1
        if n:
            rows = self.rows[:n]
            fixed = rows != 0
            comparable = fixed.sum(1)
            score = np.where(comparable == 0, 1.0, ((rows == x) & fixed).sum(1) / np.maximum(comparable, 1))
            best = int(score.argmax())
            if score[best] < self.threshold:
                best = -1
        if best < 0:
            best = n
            self.rows = self._room(self.rows, n)
            self.rows[n] = x
            self.firsts.append(tokens)
            grown = False
        else:
            new = np.where(self.rows[best] == x, x, 0)
            grown = bool((new != self.rows[best]).any())
            self.rows[best] = new
        k = len(self.owner)
        self.lists = self._room(self.lists, k)
        self.lists[k] = x
        self.owner.append(best)
        self.moves.append((k, seq, best))
        if grown and k:
            own = np.array(self.owner)
            later = np.flatnonzero(own > best)
            if len(later):
                row = self.rows[best]
                fits = later[((self.lists[later] == row) | (row == 0)).all(1)]
                for i in fits.tolist():
                    self.owner[i] = best
                    self.moves.append((i, seq, best))

    def template(self, k: int) -> tuple[str, str]:
        names = {v: t for t, v in self.code.items()}
        return "tpl_" + hashlib.sha1(" ".join(self.firsts[k]).encode()).hexdigest()[:10], " ".join(names[c] for c in self.rows[k].tolist())


def _fold(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        lists = [json.loads(t) for t in pdf["tokens"]]
        miner = TemplateMiner(len(lists[0]), threshold)
        for seq, tokens in zip(pdf["seq"].tolist(), lists):
            miner.add(seq, tokens)
        named = [miner.template(k) for k in range(len(miner.firsts))]
        keys = pdf["key"].tolist()
        until: dict[int, int] = {}
        out = []
        for i, since, k in reversed(miner.moves):
            out.append((keys[i], since, until.get(i, 2**63 - 1), *named[k]))
            until[i] = since
        return pd.DataFrame(out, columns=["key", "since", "until", "template_id", "template"])

    return run


def assign_templates(events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``events`` with template_id and template (its final text).

    The clustering depends on arrival order. Lists of different length never meet, and only
    the first arrival of each distinct list changes a cluster, so the ordered fold sees one
    row for each distinct list, by length; all events then join their list's template of the
    time. A takeover during an event's own arrival holds from later arrivals on.
    """
    listed = events.withColumn("_tokens", _message_tokens()).withColumn("_key", F.xxhash64("_tokens"))
    distinct = listed.groupBy(F.col("_key").alias("key")).agg(F.min("seq").alias("seq"), F.first("_tokens").alias("t"))
    distinct = distinct.select("key", "seq", F.size("t").alias("n"), F.to_json("t").alias("tokens"))
    found = distinct.groupBy("n").applyInPandas(_fold(threshold), "key long, since long, until long, template_id string, template string")
    on = (F.col("_key") == F.col("key")) & (F.col("seq") >= F.col("since")) & (F.col("seq") < F.col("until"))
    return listed.drop("_tokens").join(found, on).drop("_key", "key", "since", "until")


def sample_messages(assigned: DataFrame, limit: int = 3) -> DataFrame:
    """template_id and its first ``limit`` different messages in arrival order, cut to 500
    characters; two that agree in what is kept are one sample."""
    cut = assigned.select("template_id", F.substring("message", 1, MAX_TEXT).alias("m"), "seq").groupBy("template_id", "m").agg(F.min("seq").alias("seq"))
    first = F.row_number().over(Window.partitionBy("template_id").orderBy("seq"))
    top = cut.withColumn("_n", first).filter(F.col("_n") <= limit)
    return top.groupBy("template_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "m"))), lambda s: s["m"]).alias("samples"))


def template_counts(assigned: DataFrame, by: str) -> DataFrame:
    """template_id, name, count, percent of a template's events by ``by``."""
    per = assigned.groupBy("template_id", F.col(by).alias("name")).agg(F.count("*").alias("count"))
    total = per.groupBy("template_id").agg(F.sum("count").alias("_t"))
    return per.join(total, "template_id").select("template_id", "name", "count", percent(F.col("count"), F.col("_t")).alias("percent"))


def template_summary(assigned: DataFrame) -> DataFrame:
    """template_id, template, count, percent, errors, first_seen_ms, last_seen_ms; most frequent first."""
    per = assigned.groupBy("template_id").agg(
        F.min("template").alias("template"), F.count("*").alias("count"), F.count_if(F.col("level").isin("error", "fatal")).alias("errors"),
        F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"),
    )
    total = per.agg(F.sum("count").alias("_t"))
    out = per.crossJoin(F.broadcast(total)).withColumn("percent", percent(F.col("count"), F.col("_t"))).drop("_t")
    return out.select("template_id", "template", "count", "percent", "errors", "first_seen_ms", "last_seen_ms").orderBy(F.desc("count"), "template_id")


def search_templates(templates: DataFrame, text: str = "", level: str | None = None, service: str | None = None, sort: str = "errors") -> DataFrame:
    """Templates whose text or samples hold ``text`` in any case, with a level or service among
    theirs; sorted by errors, count, latest or template. Works on nested template rows."""
    df = templates
    if text:
        df = df.filter(F.lower(F.concat_ws(" ", "template", F.array_join("samples", " "))).contains(text.lower()))
    for column, wanted in (("levels", level), ("services", service)):
        if wanted:
            df = df.filter(F.exists(column, lambda x: x["name"] == wanted))
    orders = {
        "errors": [F.desc("errors"), F.desc("count")], "count": [F.desc("count")], "latest": [F.desc_nulls_last("last_seen_ms")], "template": [F.asc("template")],
    }
    return df.orderBy(*orders[sort], "template_id")
