"""Substring deduplication: compressed FM-indexes of shards, matched by backward search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, materialise, run_on_texts, scratch, table
from .fmindex import FMIndex
from .hashing import _BASE, mix, powers, windows, word_hashes

#: Words of a window; what repeats over so many words is removed.
WINDOW = 50
#: Words of an anchor. Each window holds one: the least hash of its runs of so many words.
ANCHOR = 8
#: Words in one index; a shard's groups are indexed a few at a time up to this size.
INDEX_WORDS = 1_500_000
#: Passages of one anchor that are indexed together; more are dealt to several shards.
SHARD_ROWS = 4096


def _tag(text: str | None) -> int:
    """Tells apart rows that share a doc_id."""
    return int.from_bytes(hashlib.md5((text or "").encode("utf-8", "replace")).digest()[:4], "little", signed=True)


def _tag_column():
    """The same of a column ``text``."""
    tag = F.conv(F.concat(*[F.substring(F.md5("text"), k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(tag >= 1 << 31, tag - (1 << 32)).otherwise(tag).cast("int")


def anchors(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, first window, last window) of each run of windows with one anchor.

    A window's anchor is the leftmost least hash among its runs of ANCHOR words, which its
    words alone decide: equal windows, wherever they stand, have equal anchors.
    """
    g = windows(h, ANCHOR)
    span = window - ANCHOR + 1
    n = len(h) - window + 1
    at, step = np.arange(len(g)), 1
    best, done, left = None, 0, span
    power = at
    while left:
        if left & 1:
            if best is None:
                best = power
            else:
                other = power[done : done + len(best) - step]
                best = best[: len(other)]
                best = np.where(g[best] <= g[other], best, other)
            done += step
        left >>= 1
        if left:
            a, b = power[:-step], power[step:]
            power = np.where(g[a] <= g[b], a, b)
            step *= 2
    best = best[:n]
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return best[first], first, np.r_[first[1:], n] - 1


def _anchored(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for pdf in batches:
            texts = pdf["text"].tolist()
            raw = [(t or "").encode("utf-8", "replace") for t in texts]
            at = 0
            while at < len(raw):  # a bounded number of bytes at a time
                to, size = at, 0
                while to < len(raw) and (to == at or size + len(raw[to]) < 1 << 21):
                    size += len(raw[to])
                    to += 1
                flat, count = word_hashes(raw[at:to])
                out, begin = [], 0
                for k, n in enumerate(count):
                    h, begin = flat[begin : begin + n], begin + n
                    if n < window:
                        continue
                    place, a, b = anchors(h, window)
                    total = np.r_[np.uint64(0), np.cumsum(h * powers(_BASE, int(n)), dtype=np.uint64)]
                    size_ = b - a + window
                    seg = mix((total[b + window] - total[a]) * powers(inverse, int(n))[a] + size_.astype(np.uint64))
                    out.append((windows(h, ANCHOR)[place], seg, np.full(len(a), pdf["id"].iloc[at + k]), np.full(len(a), _tag(texts[at + k])), a, size_))
                at = to
                if out:
                    c = [np.concatenate(x) for x in zip(*out)]
                    yield pd.DataFrame({"anchor": c[0].view(np.int64), "seg": c[1].view(np.int64), "id": c[2].astype(np.int64), "tag": c[3].astype(np.int32), "at": c[4].astype(np.int32), "n": c[5].astype(np.int32)})

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the passages wanted of each document, as hashes and as a digest, for every
    shard that needs them."""
    names = ("anchor", "shard", "own", "seg", "id", "last", "digest", "words")
    for pdf in batches:
        rows: dict[str, list] = {k: [] for k in names}
        for i, text, wanted in zip(pdf["id"], pdf["text"], pdf["wanted"]):
            raw = (text or "").encode("utf-8", "replace")
            h, _ = word_hashes([raw])
            split = raw.split()
            for w in wanted:
                cut = slice(w["at"], w["at"] + w["n"])
                words, digest = h[cut].tobytes(), _digest(split[cut])
                for shard in range(w["shards"]):
                    for name, value in zip(names, (w["anchor"], shard, shard == w["shard"], w["seg"], i, w["last"], digest, words)):
                        rows[name].append(value)
                if len(rows["id"]) > 5000:
                    yield pd.DataFrame(rows)
                    rows = {k: [] for k in names}
        if rows["id"]:
            yield pd.DataFrame(rows)


def _matched(window: int):
    """Intervals above the threshold: runs of windows that a document of a smaller id than the
    passage's last one holds too, with the smallest such id."""

    def report(texts: list, streams: list) -> pd.DataFrame:
        index = FMIndex([t[0] for t in texts], np.array([t[1] for t in texts], np.int64), window)
        rows = []
        for i in range(0, len(streams), 20_000):
            part = streams[i : i + 20_000]
            size = np.array([len(s[0]) for s in part])
            _, least = index.matches([s[0] for s in part])
            who = np.repeat(np.arange(len(part)), size)
            hit = least < np.array([s[3] for s in part], np.int64)[who]
            # runs of hits of one owner within a passage
            place = np.arange(len(least)) - np.repeat(np.cumsum(size) - size, size)
            same = np.r_[False, (who[1:] == who[:-1]) & hit[1:] & hit[:-1] & (least[1:] == least[:-1])]
            on, off = np.flatnonzero(hit & ~same), np.flatnonzero(hit & ~np.r_[same[1:], False])
            for a, b in zip(on, off):
                s = part[who[a]]
                rows.append((s[1], s[2], int(place[a]), int(place[b]) + window, int(least[a]), s[4]))
        return pd.DataFrame(rows, columns=["anchor", "seg", "start", "end", "owner", "digest"]).astype({"anchor": np.int64, "seg": np.int64, "start": np.int32, "end": np.int32, "owner": np.int64})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, streams, size, current, since = [], [], 0, None, 0
        for pdf in batches:
            for anchor, shard, own, seg, i, last, digest, words in zip(*(pdf[c] for c in ("anchor", "shard", "own", "seg", "id", "last", "digest", "words"))):
                if (anchor, shard) != current:
                    current = (anchor, shard)
                    if size >= INDEX_WORDS:
                        yield report(texts, streams)
                        texts, streams, size = [], [], 0
                    since = len(texts)
                elif size >= 2 * INDEX_WORDS and not own:  # a large group goes on against the same texts
                    yield report(texts, streams)
                    texts, streams = texts[since:], []
                    size, since = sum(len(t[0]) for t in texts), 0
                h = np.frombuffer(words, np.uint64)
                if own:  # a group's own passages come first
                    texts.append((h, i))
                streams.append((h, anchor, seg, last, digest))
                size += len(h)
        if streams:
            yield report(texts, streams)

    return run


def _kept(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                words = (text or "").encode("utf-8", "replace").split()
                drop = np.zeros(len(words) + 1, np.int32)
                for s in spans if spans is not None else ():
                    # what the shard matched has to be this document's words, not only their hashes
                    if _digest(words[s["at"] : s["at"] + s["n"]]) == s["digest"]:
                        drop[s["at"] + s["start"]] += 1
                        drop[s["at"] + s["end"]] -= 1
                gone = np.cumsum(drop)[: len(words)] > 0
                left = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            yield pd.DataFrame({"doc_id": pdf["id"], "n_words": [o[0] for o in out], "n_removed": [o[1] for o in out], "kept_sha256": [o[2] for o in out], "kept": [o[3] for o in out]}).astype({"n_words": np.int64, "n_removed": np.int64})

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, tag, at, n, start, end, digest): passages ``n`` words from ``at`` whose words from
    ``start`` to ``end`` are windows that start in a document of smaller id too.

    Every run of windows with one anchor is a passage; equal windows have equal anchors. The
    distinct passages of an anchor that more than one document has are taken from their
    earliest documents. Each shard indexes its passages' words in an FM-index, and passages
    stream past it, each distinct one once, for all documents that have it: backward search
    gives for each window the earliest document that holds it, and the passage's documents
    after that one repeat the window. Passages of an anchor beyond ``shard_rows`` are dealt
    to shards that all of them stream past.
    """
    mine = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null and text is not null")
    found = run_on_texts(mine.mapInPandas(_anchored(window), "anchor long, seg long, id long, tag int, at int, n int"))
    first = F.min(F.struct("id", "tag", "at", "n")).alias("f")
    segs = found.groupBy("anchor", "seg").agg(first, F.max("id").alias("last"))
    segs = materialise(segs.select("anchor", "seg", "f.*", "last"))
    many = segs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("id").alias("_lo"), F.max("last").alias("_hi")).filter("_lo < _hi")
    many = many.select("anchor", F.ceil(F.col("c") / shard_rows).cast("int").alias("shards"))
    wanted = segs.join(many, "anchor").withColumn("shard", F.pmod(F.xxhash64("seg"), F.col("shards")).cast("int"))
    wanted = materialise(wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", "seg", "shards", "shard", "at", "n", "last")).alias("wanted")))
    n = wanted.count()
    texts = mine.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi") if n <= 1_000_000 else mine
    rows = wanted.join(texts.withColumn("_t", _tag_column()), "id").filter("tag = _t")
    rows = rows.mapInPandas(_cut_out, "anchor long, shard int, own boolean, seg long, id long, last long, digest binary, words binary")
    rows = rows.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", F.col("own").desc(), "id")
    hits = run_on_texts(rows.mapInPandas(_matched(window), "anchor long, seg long, start int, end int, owner long, digest binary")).distinct()
    return found.join(hits, ["anchor", "seg"]).filter("id > owner").select("id", "tag", "at", "n", "start", "end", "digest")


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS, with_text: bool = True) -> DataFrame:
    """Remove the words of every ``window``-word passage that starts in an earlier document too.

    Returns doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by single
    spaces; null without ``with_text``), one row for each row of ``docs``. Windows are judged
    on the input. Null texts have no words; texts shorter than a window lose none; rows with
    null doc_ids neither lose words nor are a source; rows that share a doc_id are no source
    for each other; very long words and texts are treated like others; an empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    with scratch() as keep:
        spans = repeated_spans(docs, window, shard_rows)
        spans = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("at", "n", "start", "end", "digest")).alias("spans"))
        spans = spans.select(F.col("id").alias("_id"), "tag", "spans")
        mine = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        both = mine.withColumn("_t", _tag_column()).join(spans, (F.col("id") == F.col("_id")) & (F.col("_t") == F.col("tag")), "left")
        out = both.select("id", "text", "spans").mapInPandas(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
        return keep(run_on_texts(out))


def op2_fm_index_repeats(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
