"""Anomalies against leave-one-out medians: error bursts, latency and frequency spikes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import bucket_of, iso_ms, number_text, round_half_py, stable_id_py

SCHEMA = "id string, type string, severity string, title string, detail string, timestamp string, observed double, expected double, score double, template_id string"
MAX_REPORTED = 100
#: A kind's least score and ratio, and the floor of the ratio's divisor.
RULES = {"error-burst": (3.0, 2.0, 0.5), "latency-spike": (3.5, 1.8, 0.001), "frequency-spike": (4.0, 3.0, 0.5)}
#: The titles.
TITLES = {"error-burst": "Error burst detected", "latency-spike": "Latency regression detected", "frequency-spike": "Template frequency spike"}
_RANK = {"critical": 3, "high": 2, "medium": 1}


def _middle(n: int) -> tuple[int, int]:
    return (n - 1) // 2, n // 2


def leave_one_out(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected, score) of each value against the median and the median absolute deviation of
    all others, in sorted order once: taking one value out shifts the middle by one place at
    most, so there are at most three medians, and one sorted list of deviations for each."""
    v = np.asarray(values, float)
    n = len(v)
    order = np.argsort(v, kind="stable")
    s = v[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lo, hi = _middle(n - 1)
    expected = (s[lo + (place <= lo)] + s[hi + (place <= hi)]) / 2
    mad = np.empty(n)
    for m in np.unique(expected):
        at = np.flatnonzero(expected == m)
        dev = np.sort(np.abs(s - m))
        out = np.searchsorted(dev, np.abs(v[at] - m))
        mad[at] = (dev[lo + (out <= lo)] + dev[hi + (out <= hi)]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(mad > 0, (v - expected) / (1.4826 * mad), (v - expected) / np.sqrt(np.maximum(expected, 1)))
    return expected, score


def _severity(score: float, ratio: float) -> str:
    return "critical" if score >= 10 or ratio >= 10 else "high" if score >= 6 or ratio >= 5 else "medium"


def _found(kind: str, stamps: list[str], values: np.ndarray, ask: np.ndarray, template: tuple[str, str] | None = None) -> list[tuple]:
    """Anomalies of one series among the places ``ask``; three others are needed to compare."""
    if len(values) < 4:
        return []
    least, factor, floor = RULES[kind]
    expected, score = leave_one_out(values)
    ratio = values / np.maximum(expected, floor)
    rows = []
    for k in np.flatnonzero(ask & (score >= least) & (ratio >= factor)).tolist():
        x, e, sc = float(values[k]), float(expected[k]), float(score[k])
        observed = round_half_py(x, 3) if kind == "latency-spike" else x
        # fixed values: the sentences
        if kind == "error-burst":
            detail = f"{number_text(x)} errors landed in this bucket; the robust baseline is {number_text(round_half_py(e, 1))}."
        elif kind == "latency-spike":
            detail = f"Bucket p95 reached {number_text(round_half_py(x, 2))} ms versus a {number_text(round_half_py(e, 2))} ms baseline."
        else:
            detail = f"“{template[1][:140]}” appeared {number_text(x)} times in one bucket."
        tid = template[0] if template else None
        ident = stable_id_py(f"{kind}:{stamps[k]}:{tid or ''}", "ano_")
        rows.append((ident, kind, _severity(sc, float(ratio[k])), TITLES[kind], detail, stamps[k], observed, round_half_py(e, 3), round_half_py(sc, 2), tid))
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def bucket_anomalies(timeline: DataFrame) -> DataFrame:
    """Error bursts and latency spikes of a timeline. The series is one row a populated bucket:
    a few years of minutes are a few million numbers, handled in one sorted pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket_ms")
        stamps = pdf["timestamp"].tolist()
        errors = pdf["errors"].to_numpy(float)
        rows = _found("error-burst", stamps, errors, errors >= 3)
        slow = pdf["latency_p95_ms"].notna().to_numpy()
        p95 = pdf["latency_p95_ms"].to_numpy(float)[slow]
        return _frame(rows + _found("latency-spike", [t for t, ok in zip(stamps, slow) if ok], p95, np.ones(len(p95), bool)))

    one = timeline.select("bucket_ms", "timestamp", "errors", "latency_p95_ms")
    return one.groupBy().applyInPandas(run, SCHEMA)


def frequency_anomalies(assigned: DataFrame, timeline: DataFrame, bucket_ms: int) -> DataFrame:
    """Templates that are far more frequent in one bucket than in all others. Buckets without a
    template count as 0: the zeros are added to its counts, not joined."""
    per = assigned.groupBy("template_id", bucket_of(F.col("event_ms"), bucket_ms).alias("b")).agg(F.count("*").alias("n"), F.min("template").alias("template"))
    keep = per.groupBy("template_id").agg(F.sum("n").alias("_n"), F.count("*").alias("_b"), F.max("n").alias("_m")).filter("_n >= 5 and _b >= 2 and _m >= 5")
    buckets = timeline.agg(F.count("*").alias("buckets"))
    per = per.join(keep.select("template_id"), "template_id").crossJoin(F.broadcast(buckets)).withColumn("timestamp", iso_ms(F.col("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["n"].to_numpy(float)
        values = np.r_[own, np.zeros(int(pdf["buckets"].iloc[0]) - len(own))]
        ask = np.r_[own >= 5, np.zeros(len(values) - len(own), bool)]
        stamps = pdf["timestamp"].tolist() + [""] * (len(values) - len(own))
        return _frame(_found("frequency-spike", stamps, values, ask, (pdf["template_id"].iloc[0], pdf["template"].iloc[0])))

    return per.groupBy("template_id").applyInPandas(run, SCHEMA)


def detect(assigned: DataFrame, timeline: DataFrame, bucket_ms: int, limit: int = MAX_REPORTED) -> DataFrame:
    """The ``limit`` foremost anomalies: by severity, then score, then time."""
    every = bucket_anomalies(timeline).unionByName(frequency_anomalies(assigned, timeline, bucket_ms))
    return in_order(every).limit(limit)


def in_order(anomalies: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for k, t in enumerate(RULES) for x in (t, k)])
    return anomalies.orderBy(F.element_at(rank, F.col("severity")).desc(), F.desc("score"), "timestamp", F.element_at(kind, F.col("type")), "template_id")
