"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import run_on_texts, scratch, table
from .scoring import MAX_TRAIN, fold_of, training_ids

#: Severity grades 0 (clean) to GRADES - 1. Labels may state grades. Where they mark only clean
#: and toxic (no label above 1), a toxic training text's grade is the tercile of its share of
#: words that mark toxic texts.
GRADES = 4
#: Features that a model keeps: those that tell the toxic training texts best from the clean.
MAX_FEATURES = 4_000
#: Word beginnings of these lengths are features beside whole words.
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> Counter:
    """Counts of the words of a whole text, lower case, and of their beginnings."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "-"] += n
    return out


class Model:
    """P(grade > k) = sigmoid(w . x - cut_k): one weight vector, ordered cuts."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, cuts: np.ndarray):
        self.index, self.weights, self.cuts = index, weights, cuts

    def strength(self, text: str | None) -> float:
        index, weights = self.index, self.weights
        total = 0.0
        begins: Counter = Counter()
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            k = index.get(w)
            if k is not None:
                total += weights[k] * np.log1p(n)
            for p in PREFIXES:
                if len(w) > p and (k := index.get(w[:p] + "-")) is not None:
                    begins[k] += n
        return float(total + sum(weights[k] * np.log1p(n) for k, n in begins.items()))

    def exceed(self, strengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.asarray(strengths)[:, None] - self.cuts).clip(-500, 500)))


def fit_cumulative(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, width: int, l2: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered cuts by full-batch Adam on the mean negative log-likelihood.

    Cuts are the first one plus exponentials, so they stay in order.
    """
    n = len(rows)
    at = np.concatenate([np.full(len(i), r) for r, (i, _) in enumerate(rows)]) if n else np.empty(0, int)
    col = np.concatenate([i for i, _ in rows]) if n else np.empty(0, int)
    val = np.concatenate([v for _, v in rows]) if n else np.empty(0)
    w, free = np.zeros(width), np.r_[1.0, np.zeros(GRADES - 2)]
    m, v = np.zeros(width + len(free)), np.zeros(width + len(free))
    share = np.bincount(grades, minlength=GRADES) / n
    # rare grades count as much as common ones, within reason
    heavy = np.minimum(1 / np.maximum(share, 1e-6), 10)[grades]
    heavy = heavy / heavy.sum()
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        cuts = np.r_[free[0], free[0] + np.cumsum(gaps)]
        s = np.bincount(at, val * w[col], minlength=n)
        over = 1 / (1 + np.exp(-(s[:, None] - cuts)))  # P(grade > k)
        full = np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))])
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-12)
        slope = full * (1 - full)
        ds = (slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / p * heavy
        dcut = np.zeros((n, GRADES + 1))
        dcut[np.arange(n), grades] -= slope[np.arange(n), grades] / p * heavy
        dcut[np.arange(n), grades + 1] += slope[np.arange(n), grades + 1] / p * heavy
        gc = dcut.sum(0)[1:GRADES]
        gw = np.bincount(col, val * ds[at], minlength=width) - l2 * w
        gf = np.r_[gc.sum(), [gc[k:].sum() * gaps[k - 1] for k in range(1, GRADES - 1)]]
        g = -np.r_[gw, gf]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:width]
        free -= move[width:]
    return w, np.r_[free[0], free[0] + np.cumsum(np.exp(free[1:]))]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        both = (Counter(), Counter())
        for text, y in zip(pdf["text"], pdf["y"]):
            both[y].update(features_of(text).keys())
        keys = list(both[1])
        yield pd.DataFrame({"f": [*keys, ""], "n1": [*(both[1][k] for k in keys), int((pdf["y"] == 1).sum())], "n0": [*([0] * len(keys)), int((pdf["y"] == 0).sum())]})
        rest = list(both[0])
        yield pd.DataFrame({"f": rest, "n1": [0] * len(rest), "n0": [both[0][k] for k in rest]})


def loss(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weights: np.ndarray, cuts: np.ndarray, l2: float = 2e-4) -> float:
    """What ``fit_cumulative`` minimises: the weighted mean negative log-likelihood, and the ridge."""
    s = np.array([(weights[i] * v).sum() for i, v in rows])
    over = np.hstack([np.ones((len(s), 1)), 1 / (1 + np.exp(-(s[:, None] - cuts))), np.zeros((len(s), 1))])
    p = over[np.arange(len(s)), grades] - over[np.arange(len(s)), grades + 1]
    share = np.bincount(grades, minlength=GRADES) / len(grades)
    heavy = np.minimum(1 / np.maximum(share, 1e-6), 10)[grades]
    return float(-(heavy / heavy.sum() * np.log(np.maximum(p, 1e-12))).sum() + l2 / 2 * (weights**2).sum())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Model:
    """Fit on a bounded sample of labelled documents outside the held-out fold; equal texts
    count once, with their largest label. Labels are 0 (clean), 1 (toxic) or grades up to
    GRADES - 1."""
    ids = training_ids(labels, "toxic", max_rows, GRADES - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    with scratch():
        # the sample is read twice: for the features' counts, and for the chosen features
        rows = run_on_texts(rows.groupBy(F.xxhash64("text").alias("_t")).agg(F.first("text").alias("text"), F.max("y").alias("g")).withColumn("y", F.least("g", F.lit(1))))
        return _fitted(rows, max_features)


def _fitted(rows: DataFrame, max_features: int) -> Model:
    counts = run_on_texts(rows.mapInPandas(_counted, "f string, n1 long, n0 long")).groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    totals = counts.filter("f = ''").first()
    t1, t0 = (totals["n1"], totals["n0"]) if totals else (0, 0)
    if not t1 or not t0:
        side = 50.0 if t1 else -50.0
        return Model({}, np.zeros(0), np.arange(GRADES - 1) - side)
    least = 2 if t1 < 50 else 4
    odds = F.log((F.col("n1") + 0.5) / (t1 + 1)) - F.log((F.col("n0") + 0.5) / (t0 + 1))
    best = counts.filter(F.col("f") != "").filter(F.col("n1") >= least).withColumn("o", odds).filter("o > 0.7")
    best = best.orderBy((F.col("o") * F.sqrt("n1")).desc(), "f").limit(max_features).toPandas()
    index = {f: k for k, f in enumerate(best["f"])}

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                c = features_of(text)
                have = sorted((index[f], n) for f, n in c.items() if f in index)
                out.append(([k for k, _ in have], [float(n) for _, n in have], sum(n for f, n in c.items() if f[-1:] != "-")))
            yield pd.DataFrame({"t": pdf["_t"], "g": pdf["g"], "k": [o[0] for o in out], "n": [o[1] for o in out], "words": [o[2] for o in out]})

    got = run_on_texts(rows.mapInPandas(picked, "t long, g int, k array<int>, n array<double>, words long")).toPandas().sort_values("t", kind="stable")
    sparse = [(np.asarray(k, int), np.log1p(np.asarray(n, float))) for k, n in zip(got["k"], got["n"])]
    grades = got["g"].to_numpy(int)
    if grades.max() == 1:
        odd = best["o"].to_numpy()
        dense = np.array([(odd[k] * v).sum() for k, v in sparse]) / np.log(got["words"].to_numpy(float) + 3)
        toxic = grades == 1
        edges = np.quantile(dense[toxic], np.linspace(0, 1, GRADES)[1:-1])
        grades[toxic] = 1 + np.searchsorted(edges, dense[toxic], "right")
    weights, cuts = fit_cumulative(sparse, grades, len(index))
    return Model(index, weights, cuts)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Severity of every row of ``docs``.

    Returns doc_id, held_out (never trained on), score (P(grade > 0)), predicted (1 if score
    >= 0.5), expected_severity (sum of P(grade > k), 0 to GRADES - 1) and severity (likeliest
    grade). Null texts count as empty; equal texts score alike; null ids and repeated rows
    keep their rows; an empty table gives none; other columns are ignored. Without both
    labels in the sample, every text scores the one label there is (none: clean).
    """
    model = train(docs, labels, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            over = model.exceed(np.array([model.strength(t) for t in pdf["text"]], float))
            each = np.hstack([np.ones((len(over), 1)), over]) - np.hstack([over, np.zeros((len(over), 1))])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": over[:, 0], "expected_severity": over.sum(1), "severity": each.argmax(1).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(True)).alias("held_out"), "text")
    out = run_on_texts(rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, expected_severity double, severity int"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "expected_severity", "severity")


def op1_cumulative_link_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
