import io
import json
import os
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import cli
from tracewell.operators.anomalies import leave_one_out
from tracewell.operators.aggregate import carry_forward, latency_summary, timeline
from tracewell.operators.precursors import find_precursors, next_failures
from tracewell.operators.templates import TemplateMiner, assign_templates
from tracewell.options import AnalyzeOptions, UsageError, parse_byte_size, parse_duration
from tracewell.plans.report import analyze, json_for_html, render_html, render_json, render_text
from tracewell.sources.lines import DEMO_SOURCE, demo_lines

NOW = datetime(2026, 7, 20, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def demo(spark):
    return analyze(spark, demo_lines(spark), AnalyzeOptions(source=DEMO_SOURCE, precursors=True, now=NOW)).to_dict()


def test_demo_totals(demo):
    s = demo["summary"]
    assert demo["schemaVersion"] == "1.1"
    assert (s["linesRead"], s["events"], s["errors"], s["warnings"], s["errorRate"], s["services"], s["templates"]) == (19, 19, 6, 4, 31.58, 3, 5)
    assert s["latency"] == {"count": 19, "minMs": 68, "maxMs": 2500, "meanMs": 753.947, "p50Ms": 118, "p95Ms": 2383, "p99Ms": 2476.6, "approximate": False}
    assert [b["latencyP95Ms"] for b in demo["timeline"]] == [114.4, 120.5, 126.6, 132.7, 2461]


def test_demo_findings(demo):
    assert [(a["id"], a["severity"], a["score"]) for a in demo["anomalies"]] == [("ano_c5e00a86c2", "critical", 258.46), ("ano_afeb16c0d9", "critical", 6)]
    p = demo["precursors"][0]
    assert (p["sourceTemplateId"], p["failureTemplateId"], p["support"], p["lift"], p["medianGapMs"]) == ("tpl_de195c1e76", "tpl_19c35e1d18", 4, 1.25, 114000)
    assert demo["privacy"] == {"redactions": 3, "byType": [{"name": n, "count": 1, "percent": 33.33} for n in ("EMAIL", "FIELD", "IP")]}


def test_forms_of_the_report(demo):
    assert json.loads(render_json(demo)) == demo and "latency" in json.loads(render_json(demo, False))["summary"]
    page = render_html(demo | {"notes": ["</script><img src=x>"]})
    assert "</script><img" not in page and "must-never-survive" not in page and "http" not in page.split("<script>")[1]
    assert "<" not in json_for_html({"x": "</script>& "})
    text = render_text(demo, 2)
    assert "19 events" in text and "[CRITICAL]" in text and "4/4" in text


def test_huge_latencies_stay_finite_and_blank_lines_count(spark):
    lines = ['{"level":"info","msg":"a","duration_ms":1e308}'] * 2 + ["", "{bad"]
    doc = analyze(spark, lines, AnalyzeOptions(now=NOW)).to_dict()
    assert doc["summary"]["latency"]["meanMs"] == 1e308
    assert (doc["summary"]["linesRead"], doc["summary"]["events"], doc["summary"]["malformedLines"]) == (4, 3, 1)
    assert doc["schemaVersion"] == "1.0" and "precursors" not in doc and len(doc["timeline"]) == 1


def test_quantiles_are_exact_over_many_ranges_and_repeated_values(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 40, 3000), rng.random(2000) * 100, np.full(2500, 7.0)])
    rows = [(int(k % 3), None if k % 11 == 0 else float(v), "error" if k % 5 == 0 else "info") for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_ms long, duration_ms double, level string")
    r = latency_summary(df).first()
    known = np.array([v for _, v, _ in rows if v is not None])
    assert (r["count"], r.min_ms, r.approximate) == (len(known), 0, False)
    assert np.allclose([r.p50_ms, r.p95_ms, r.p99_ms, r.mean_ms], [*np.quantile(known, [0.5, 0.95, 0.99]), known.mean()], atol=6e-4)
    for b in timeline(df, 1).collect():
        mine = [(v, level) for k, v, level in rows if k == b.bucket_ms]
        assert (b["count"], b.errors) == (len(mine), sum(level == "error" for _, level in mine))
        assert abs(b.latency_p95_ms - np.quantile([v for v, _ in mine if v is not None], 0.95)) < 6e-4
    none = latency_summary(df.filter("duration_ms is null")).first()
    assert (none["count"], none.p50_ms, none.mean_ms) == (0, None, None)


def test_miner_is_the_sequential_one(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "<*>", "d"]
    messages = [" ".join(rng.choice(words, 4)) for _ in range(300)]
    clusters, want = [], []
    for m in messages:
        t, best, score = m.split(), None, -1.0
        for c in clusters:
            fixed = [i for i in range(4) if c[1][i] != "<*>"]
            s = sum(c[1][i] == t[i] for i in fixed) / len(fixed) if fixed else 1.0
            if s > score:
                best, score = c, s
        if best is None or score < 0.6:
            best = (t, list(t))
            clusters.append(best)
        else:
            best[1][:] = [x if x == y else "<*>" for x, y in zip(best[1], t)]
        want.append(" ".join(best[0]))
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(messages)], "seq long, message string")
    got = assign_templates(rows).orderBy("seq").collect()
    miner = TemplateMiner(4, 0.6)
    ids = {" ".join(c[0]): " ".join(c[1]) for c in clusters}
    import hashlib

    assert len(got) == 300 and miner.firsts == []
    assert [g.template_id for g in got] == ["tpl_" + hashlib.sha1(w.encode()).hexdigest()[:10] for w in want]
    assert [g.template for g in got] == [ids[w] for w in want]


def test_leave_one_out_is_the_plain_one():
    rng = np.random.default_rng(1)
    for n in (4, 5, 8, 31):
        v = rng.integers(0, 6, n).astype(float)
        expected, score = leave_one_out(v)
        for k in range(n):
            rest = np.delete(v, k)
            m = np.median(rest)
            mad = np.median(np.abs(rest - m))
            assert expected[k] == m
            assert score[k] == pytest.approx((v[k] - m) / (1.4826 * mad) if mad else (v[k] - m) / np.sqrt(max(m, 1)))


def _events(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts_ms long, service string, template_id string, failure boolean")


def test_precursors_boundaries(spark):
    rows = [(k, 1_000_000 * k, "a", "warn", False) for k in range(4)] + [(10 + k, 1_000_000 * k + 5000, "a", "fail", True) for k in range(4)]
    rows += [(20 + k, 1_000_000 * k + 500_000, "a", "idle", False) for k in range(8)] + [(40, 1, "b", "warn", False), (41, 1, "b", "fail", True), (42, 2, "b", "fail", True)]
    out = find_precursors(_events(spark, rows)).collect()
    assert [(r.service, r.source_template_id, r.occurrences, r.support, r.support_percent, r.lift, r.median_gap_ms) for r in out] == [("a", "warn", 4, 4, 100.0, 3.0, 5000.0)]
    tied = {r.seq: r.failure_template_id for r in next_failures(_events(spark, rows)).filter("service = 'b'").collect()}
    assert tied == {40: None}  # one at the same time, arrived later, hides the next


def test_carry_forward_over_chunks(spark):
    rows = [(k * 40_000, None if k % 3 else k) for k in range(1, 12)]
    got = [r.event_ms for r in carry_forward(spark.createDataFrame(rows, "seq long, ts_ms long"), 77).orderBy("seq").collect()]
    assert got == [77, 77, 3, 3, 3, 6, 6, 6, 9, 9, 9]


def test_options():
    assert (parse_duration("1.5m"), parse_duration("250"), parse_byte_size("2MB")) == (90_000, 250, 2 * 1024**2)
    for bad in ("5 days", ""):
        with pytest.raises(UsageError):
            parse_duration(bad)
    with pytest.raises(UsageError):
        parse_byte_size("10b")
    with pytest.raises(UsageError):
        AnalyzeOptions(bucket_ms=10).validate()


@pytest.mark.parametrize("argv", [["--top", "0"], ["a", "b"], ["demo", "x"], ["--sequence-window", "5m", "x"], ["--json", "-", "--format", "json", "x"], ["--json", "p", "--html", "p", "x"], ["--open", "x"], ["--nope"], ["/no/such/file.gz"]])
def test_usage_errors(argv, spark):
    assert cli.run(argv, spark) == 2


def test_cli_demo(spark, tmp_path, capsys):
    assert cli.run(["demo", "--html", str(tmp_path / "r.html"), "--json", "-", "--fail-on-anomaly"], spark) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["events"] == 19
    assert (tmp_path / "r.html").stat().st_mode & 0o077 == 0


def test_streams(spark, tmp_path):
    from tracewell.streaming.live import stream_events, stream_lines, stream_templates, stream_timeline

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("".join(f"2026-07-19T08:0{m}:0{k}Z ERROR [x] job {k} failed for u{k} duration={k}ms\n" for m in range(3) for k in range(4)))
    events = stream_events(stream_lines(spark, str(src)), 2026)
    for name, df, mode in (("tl", stream_timeline(events), "complete"), ("tp", stream_templates(events), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.table("tl").select("count", "errors", "latency_p95_ms").collect())) == [(4, 4, 2.85)] * 3
    assert [(r.template, r["count"]) for r in spark.table("tp").collect()] == [("job <num> failed for <*> <*>", 12)]


def test_streamed_arrival(spark, tmp_path):
    """Files of one time keep apart, in order of path; more than 2 ** 21 lines of a file are told apart."""
    from tracewell.streaming.live import stream_lines, stream_templates

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name)

    src = tmp_path / "in"
    src.mkdir()
    for name, first in (("b.log", "late"), ("a.log", "early")):
        (src / name).write_text(f"{first} job of worker failed\n\n")
        os.utime(src / name, (1_780_000_000, 1_780_000_000))
    (src / "none.log").write_text("")
    lines = stream_lines(spark, str(src))
    rows = run(lines, "arrivals", "append").orderBy("seq").collect()
    assert [(r.seq.file[-5:], r.seq.place) for r in rows] == [("a.log", 0), ("a.log", 1), ("b.log", 0), ("b.log", 1)]
    events = lines.filter("text <> ''").select("seq", F.col("text").alias("message"))
    found = run(stream_templates(events), "arrived", "update").collect()
    assert [(r.template, r["count"]) for r in found] == [("<*> job of worker failed", 2)]

    many = tmp_path / "many"
    many.mkdir()
    (many / "c.log").write_text("x\n" * ((1 << 21) + 2))
    last = stream_lines(spark, str(many)).groupBy().agg(F.count("*").alias("n"), F.max("seq.place").alias("last"))
    assert run(last, "places", "complete").first() == ((1 << 21) + 2, (1 << 21) + 1)


def test_standard_input(spark, monkeypatch):
    """Standard input goes through the shared folder and is removed with what is made there."""
    from tracewell.sources.lines import stdin_lines
    from tracewell.storage import scratch, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("one\r\ntwö\n".encode() + b"y" * 3_000_000)))
    with scratch():
        rows = stdin_lines(spark).orderBy("seq").collect()
        assert [(r.text[:3], r.truncated) for r in rows] == [("one", False), ("twö", False), ("yyy", True)]
        assert len(rows[2].text) == 2_000_000
    assert set(folder.iterdir()) == before
