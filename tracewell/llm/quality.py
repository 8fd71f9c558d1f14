"""Quality classifier: Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import run_on_texts, small_batches, table, whole_rows
from .scoring import MAX_TRAIN, fold_of, training_ids

#: Preference pairs drawn for training, each a good and a bad document of the sample.
MAX_PAIRS = 200_000
RIDGE = 1e-3
#: Pairs whose differences are held at once.
PAIR_ROWS = 10_000
_PUNCTUATION = b"!?*#%&$|<>{}[]()=+_~^\\/@\"'`:;,.-"


def features_of(text: str | None) -> list[float]:
    """Shares and ratios of a whole text; an empty or null text has all zeros but the first."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [1.0] + [0.0] * (len(NAMES) - 1)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = byte[65:91].sum(), byte[97:123].sum(), byte[48:58].sum()
    lines = raw.split(b"\n")
    counts = Counter(words)
    kinds = len(counts)
    top = max(counts.values())
    same = sum(map(bytes.__eq__, words, words[1:]))
    shouting = sum(map(bytes.isupper, words))
    filled = [x for x in lines if x.strip()]
    again = len(filled) - len(set(filled))
    marks = byte[list(_PUNCTUATION)]
    tails = Counter(x[-1] for x in words)
    tail_share = sum(tails.get(c, 0) for c in b"!*#%&$|") / w
    lengths = n / w
    return [
        0.0, np.log1p(w), upper / n, lower / n, digit / n, byte[128:].sum() / n, (upper + 1) / (upper + lower + 2),
        same / w, shouting / w, kinds / w, np.log(kinds + 1) / np.log(w + 1), top / w, again / len(filled), np.log1p(len(filled)), w / len(filled) / 100,
        lengths / 10, byte[10] / n, byte[32] / n, tail_share, *(np.sqrt(marks / w)), marks.sum() / n,
    ]


NAMES = [
    "empty", "log_words", "upper", "lower", "digit", "wide", "upper_of_ascii", "adjacent_same", "shouting", "kinds", "log_kinds", "top_word",
    "repeated_lines", "log_lines", "words_a_line", "word_length", "newlines", "spaces", "mark_tails", *(f"mark_{c}" for c in _PUNCTUATION), "marks",
]


def _expand(x: np.ndarray) -> np.ndarray:
    """The features, and how far each stands above two low marks, so that a small share of a
    rare sign counts."""
    return np.hstack([x, np.minimum(x, 0.02) * 10, np.minimum(x, 0.2)])


class Ranker:
    """score(x) = sigmoid((w . x - cut) / spread), w fitted to pairs, cut a score quantile."""

    def __init__(self, mean, scale, weights, cut: float, spread: float):
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((_expand(x) - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-((self.strength(x) - self.cut) / self.spread).clip(-500, 500)))


def fit(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, seed: int = 3) -> Ranker:
    """Bradley-Terry: P(good beats bad) = sigmoid(w . (x_good - x_bad)), by Newton steps on the
    pairs' logistic loss. The cut is the quantile of the sample's scores that leaves the
    sample's share of bad documents below it, then moved to the best balanced accuracy among
    nearby quantiles. With one class or no rows every document scores that class (none: 0.5).
    """
    width = 3 * len(NAMES)
    if len(set(y.tolist())) < 2:
        prior = 0.0 if not len(y) else (20.0 if y[0] else -20.0)
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -prior, 1.0)
    z = _expand(x)
    mean, scale = z.mean(0), z.std(0) + 1e-9
    z = ((z - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(max_pairs, len(good) * len(bad), 50 * len(y))
    a, b = rng.choice(good, n), rng.choice(bad, n)
    w = np.zeros(width)
    for _ in range(25):
        grad, hess = RIDGE * w, RIDGE * np.eye(width)
        for k in range(0, n, PAIR_ROWS):  # the differences of all pairs at once would take much memory
            d = z[a[k : k + PAIR_ROWS]] - z[b[k : k + PAIR_ROWS]]
            p = 1 / (1 + np.exp(-(d @ w).clip(-500, 500)))
            grad += d.T @ (p - 1) / n
            hess += (d * (p * (1 - p))[:, None]).T @ d / n
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    share = len(bad) / len(y)
    quantiles = np.unique(np.clip(share * np.linspace(0.5, 1.5, 41), 0, 1))
    cuts = np.quantile(s, quantiles)
    balanced = [((s[good] >= c).mean() + (s[bad] < c).mean()) / 2 for c in cuts]
    best = np.flatnonzero(np.array(balanced) >= max(balanced) - 1e-12)
    cut = float(cuts[best[np.abs(quantiles[best] - share).argmin()]])
    return Ranker(mean, scale, w, cut, float(s.std() + 1e-9) / 4)


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [features_of(t) for t in pdf["text"]]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Ranker:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    ids = training_ids(labels, "quality", max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    with small_batches(docs.sparkSession):
        got = rows.mapInPandas(_measured, "doc_id long, y int, x array<double>").toPandas()
    got = got.iloc[sorted(range(len(got)), key=lambda k: (got["doc_id"].iloc[k], list(got["x"].iloc[k])))]
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return fit(x, got["y"].to_numpy(int))


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels, lang, source and doc_id are never inputs of a score. Null texts count as empty;
    equal texts score alike; null ids count as held out of training; repeated rows each get
    a row; an empty table gives none; other columns are ignored.
    """
    ranker = train(docs, labels, max_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features_of(t) for t in pdf["text"]], float).reshape(len(pdf), len(NAMES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": ranker.score(x)})

    rows = docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(True)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = run_on_texts(rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject (score >= 0.5), with all their
    columns and no others, whatever their names.

    Null texts count as empty and, like all equal texts, stay or go together; rows with null
    or repeated ids are judged each by its text; an empty table gives no rows.
    """
    ranker = train(docs, labels, max_rows)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(np.array([features_of(t) for t in text], float).reshape(len(text), len(NAMES))))

    rows = docs.select(whole_rows(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return run_on_texts(rows.filter(scored(F.col("text")) >= 0.5).select("row.*"))


def op5_bradley_terry_quality(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
