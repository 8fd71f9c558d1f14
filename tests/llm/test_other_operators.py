import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import lattice, warc


def cosine_links(rows):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ok = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    ids = sorted(i for i, _ in rows if i is not None)
    count, label = {i: 0 for i in ids}, {i: i for i in ids}
    pairs = [(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    for a, _ in pairs:
        count[a] += 1
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return count, label


@pytest.mark.parametrize("block_rows", [2048, 5])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_of_vectors(spark, kind, block_rows):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(40):
        c = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((k, np.float32(c + 0.08 * rng.standard_normal(32)).tolist()))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, rows[0][1]), (k + 2, [2 * x for x in rows[5][1]]), (k + 3, None), (k + 4, [0.0] * 32), (k + 5, [float("nan")] * 32), (k + 6, [None] + [1.0] * 31), (k + 7, [1.0, 2.0]), (k + 8, [1.0, 2.0]), (k + 9, []), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, w int, cell string")
    count, label = cosine_links(rows)
    got = {r.vec_id: r for r in lattice.link_vectors(df, block_rows=block_rows).collect()}
    assert len(got) == len(rows) and got[None].n_links == 0
    for i in count:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], label[i], label[i] == i), i
    assert lattice.link_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    grid = lattice.Lattice(64)
    a, b = grid.cells(u), grid.cells(0.9 * u + np.sqrt(1 - 0.81) * w)
    assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() >= 0.98


def test_e8_points_are_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    best = lattice.decode_e8(x)
    steps = lattice.minimal_vectors()
    assert len(steps) == 240 and (best.sum(1) % 4 == 0).all()
    near = ((x - best / 2) ** 2).sum(1)
    assert all((((x[k] - (best[k] + steps) / 2) ** 2).sum(1) >= near[k] - 1e-12).all() for k in range(300))


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2", "https://example.com/a/b", "not a url", None, "", "http://h?ref=1&q="]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    got = [r.c for r in df.select("i", warc.canonical_url(df.u).alias("c")).orderBy("i").collect()]
    assert got == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "example.com/a/b", None, None, None, "h?q="]


@pytest.mark.parametrize("ranges", [1, 7, 512])
def test_revisits_as_of(spark, ranges):
    rng = np.random.default_rng(4)
    urls = ["http://a.com/x", "https://www.a.com/x/", "http://b.com/y", None, "bad"]
    rows = []
    for k in range(400):
        kind = "revisit" if rng.random() < 0.5 else "response" if rng.random() < 0.9 else "metadata"
        tag = None if rng.random() < 0.2 else ("W/" if rng.random() < 0.3 else "") + f'"{rng.integers(3)}"'
        ts = None if rng.random() < 0.05 else int(rng.integers(120))
        rows.append((k, urls[rng.choice(5, p=[0.5, 0.2, 0.2, 0.05, 0.05])], ts, kind, tag, f"d{rng.integers(2)}", {"Date": str(k), "X": "1"} if kind == "response" else {"date": "new", "Content-Length": "0"}, f"p{k}", 1))
    df = spark.createDataFrame(rows, "rec_id long, url string, ts long, rec_type string, etag string, last_modified string, headers map<string,string>, digest string, status int")
    df = df.withColumn("http_status", F.when(F.col("rec_id") % 11 == 0, 503).when(F.col("rec_id") % 3 == 0, 200))
    key = {"http://a.com/x": "a.com/x", "https://www.a.com/x/": "a.com/x", "http://b.com/y": "b.com/y"}
    got = {r.rec_id: r for r in warc.resolve_revisits(df, ranges).collect()}
    assert len(got) == sum(r[3] == "revisit" for r in rows)
    for r in rows:
        if r[3] != "revisit":
            continue
        before = [x for x in rows if x[3] == "response" and x[0] % 11 and key.get(x[1]) and key.get(x[1]) == key.get(r[1]) and None not in (x[2], r[2]) and x[2] < r[2]]
        best = max(before, key=lambda x: (x[2], x[0]), default=None)
        plain = lambda e: e.removeprefix("W/")
        same = best and (plain(r[4]) == plain(best[4]) if r[4] and best[4] else r[5] == best[5])
        g = got[r[0]]
        assert (g.response_id, g.status) == (best and best[0], "unresolved" if not best else "resolved" if same else "mismatch"), r
        assert (g.headers, g.digest) == (({"x": "1", "date": "new"}, best[7]) if best and same else (None, None))
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_headers_in_several_spellings(spark):
    df = spark.createDataFrame([({"Via": "a", "via": "b", "VIA": "c", "X-Y": "1", "x-y": "2"}, {"DATE": "new", "Date": "newer", "x-y": "3"}), (None, None), ({"A": None}, {})], "s map<string,string>, f map<string,string>")
    assert [r.m for r in df.select(warc.merge_headers(df.s, df.f).alias("m")).collect()] == [{"via": "b", "x-y": "2", "date": "newer"}, {}, {"a": None}]


def test_bursts_are_dealt_evenly(spark):
    from tracewell.llm.common import bounds_of, bucket_of

    df = spark.createDataFrame([(k,) for k in [*range(1000), 2**60, -(2**60), None]], "x long")
    out = df.groupBy(bucket_of(F.col("x"), bounds_of(df, "x", 10)).alias("b")).count().collect()
    assert len(out) == 11 and max(r["count"] for r in out) <= 130
    assert bounds_of(df.limit(0), "x", 10) == []
