"""Document near-duplicates: MinHash in an LSH forest, confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import broadcast_if_small, components, materialise, run_on_texts, scratch, small_batches, table, whole_rows
from .hashing import mix, windows, word_hashes

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Trees of the forest, each ordering the documents by DEPTH signature values of its own.
#: Regions share the first LEAST of them: a pair at 0.75 meets in none of 20 trees with
#: probability (1 - 0.75 ** 3) ** 20 = 2e-5.
TREES, DEPTH, LEAST = 20, 6, 3
#: Trees whose neighbours are confirmed first; those of the others only where they still
#: lie in different components.
FIRST_TREES = 2
#: Rows from which a region is looked at DEPTH deep before it is looked at LEAST deep.
CROWD = 256
#: Partners, the likeliest ones of other components, that each outsider of a region asks first.
NEXT = 2
#: Partners that are confirmed beside one text in one task.
CHUNK = 64
#: Rows, and shingles, of one side of a comparison in one task; larger regions are dealt to
#: blocks of those asked and chunks of those that ask.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
_PERMS = TREES * DEPTH


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (A-Z lower-cased); a text with fewer
    words than a shingle is one shingle, one without words none."""
    h, _ = word_hashes([(text or b"").lower()])
    if not len(h):
        return h
    return np.unique(windows(h, min(SHINGLE, len(h))))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 2**63, _PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, _PERMS, dtype=np.uint64)


def signature(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of a set of hashes under every permutation."""
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(u), 4096):
        low = np.minimum(low, (u[i : i + 4096, None] * a + b).min(0))
    return (mix(low) >> np.uint64(32)).astype(np.uint32)


def sketch(u: np.ndarray) -> bytes:
    """Parity of the set's members by the low bits of their hashes, in 2 to 4 bits a member.

    Every member that only one of two sets has flips one bit, so sketches never differ in
    more bits than the sets differ in members: a bound that proves a pair to be no link.
    Half the sketch laid over the other half is the sketch of half the size.
    """
    bits = 1 << max(6, (2 * len(u) - 1).bit_length())
    count = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of some sets; ``differ`` gives for pairs of them how many members at least only
    one has, and ``possible`` which pairs can be links."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n = np.asarray(n, np.int64)
        words = np.array([len(b) // 8 for b in bits], np.int64)
        self.level = np.array([int(w).bit_length() - 1 for w in words], np.int64)
        self.at = np.zeros(len(bits), np.int64)
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        for level in np.unique(self.level).tolist():
            own = np.flatnonzero(self.level == level)
            self.at[own] = np.arange(len(own))
            self.rows[level, level] = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(len(own), 1 << level)

    def _matrix(self, level: int, to: int) -> np.ndarray:
        if (level, to) not in self.rows:
            up = self._matrix(level, to + 1)
            self.rows[level, to] = up[:, : 1 << to] ^ up[:, 1 << to :]
        return self.rows[level, to]

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        kinds = self.level[x] * 64 + self.level[y]
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            lx, ly = divmod(kind, 64)
            low = min(lx, ly)
            a, b = self._matrix(lx, low), self._matrix(ly, low)
            step = max(1, (1 << 21) >> low)
            for k in range(0, len(at), step):
                i = at[k : k + step]
                out[i] = np.bitwise_count(a[self.at[x[i]]] ^ b[self.at[y[i]]]).sum(1)
        return out

    def possible(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs no bound excludes, the share that differs at least, for those)."""
        nx, ny = self.n[x], self.n[y]
        ok = np.flatnonzero(100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny))
        both = nx[ok] + ny[ok]
        d = self.differ(x[ok], y[ok])
        near = (100 + PERCENT) * d <= (100 - PERCENT) * both
        return ok[near], d[near] / both[near]


def linked(u: np.ndarray, v: np.ndarray) -> bool:
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= PERCENT * (len(u) + len(v) - both)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size, digest, forest values and sketch of every text's set."""
    a, b = _multipliers()
    step = np.uint64(0x9E3779B97F4A7C15)
    for pdf in batches:
        out: dict[str, list] = {k: [] for k in ("n", "key", "homes", "deep", "bits")}
        for text in pdf["text"]:
            u = shingles(None if text is None else text.encode("utf-8", "replace"))
            out["n"].append(len(u))
            out["key"].append(hashlib.md5(u.tobytes()).hexdigest())
            if len(u):
                sig = signature(u, a, b).reshape(TREES, DEPTH)
                home = np.arange(1, TREES + 1, dtype=np.uint64)
                for k in range(LEAST):
                    home = mix(home * step + sig[:, k].astype(np.uint64))
                out["homes"].append(home.tobytes())
                out["deep"].append(sig[:, LEAST:].astype(">u4").tobytes())
                out["bits"].append(sketch(u))
            else:
                for k in ("homes", "deep", "bits"):
                    out[k].append(b"")
        yield pd.DataFrame({"id": pdf["id"], **out})


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each tree: the region (its first LEAST values) and the deeper values."""
    size = 4 * (DEPTH - LEAST)
    for pdf in batches:
        homes = np.frombuffer(b"".join(pdf["homes"]), np.int64)
        deep = [d[k : k + size] for d in pdf["deep"] for k in range(0, TREES * size, size)]
        yield pd.DataFrame({"tree": np.tile(np.arange(TREES, dtype=np.int32), len(pdf)), "region": homes, "deep": deep, "id": np.repeat(pdf["id"].to_numpy(), TREES), "n": np.repeat(pdf["n"].to_numpy(), TREES)})


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours in the sorted orders that share a region; and the first and last row of the
    partition, whose neighbours are in others."""
    part, last, first = TaskContext.get().partitionId(), None, None

    def rows(a, b, tree, region, edge) -> pd.DataFrame:
        return pd.DataFrame({"a": a, "b": b, "tree": tree, "region": region, "part": part, "edge": edge}).astype({"a": np.int64, "b": np.int64, "tree": np.int32, "region": np.int64, "part": np.int32, "edge": np.int32})

    for pdf in batches:
        if not len(pdf):
            continue
        region, ids, tree = (pdf[c].to_numpy() for c in ("region", "id", "tree"))
        if last is None:
            first = (ids[0], tree[0], region[0])
        else:
            region, ids, tree = np.r_[last[2], region], np.r_[last[0], ids], np.r_[last[1], tree]
        last = (ids[-1], tree[-1], region[-1])
        same = (region[1:] == region[:-1]) & (tree[1:] == tree[:-1])
        x, y = ids[:-1][same], ids[1:][same]
        yield rows(np.minimum(x, y), np.maximum(x, y), tree[1:][same], region[1:][same], 0)
    if first is not None:
        for row, edge in ((first, 1), (last, 2)):
            yield rows([row[0]], [row[0]], [row[1]], [row[2]], edge)


def neighbours(regions: DataFrame) -> DataFrame:
    """(a, b, tree): pairs that stand side by side in a tree's order and share a region; the
    longest common prefix that a document has with any other is that with a neighbour. The
    orders are sorted by range, so a crowded region is spread over partitions."""
    order = ["tree", "region", "deep", "id"]
    dealt = regions.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(dealt.mapInPandas(_neighbours, "a long, b long, tree int, region long, part int, edge int"))
    # two rows a partition: the last of one stands before the first of the next
    down = Window.orderBy("part", "edge")
    ends = found.filter("edge > 0").select("*", *[F.lead(c).over(down).alias(f"_{c}") for c in ("a", "tree", "region", "edge")])
    ends = ends.filter("edge = 2 and _edge = 1 and tree = _tree and region = _region and a <> _a")
    across = ends.select(F.least("a", "_a").alias("a"), F.greatest("a", "_a").alias("b"), "tree")
    pairs = found.filter("edge = 0").select("a", "b", "tree").unionByName(across)
    return pairs.groupBy("a", "b").agg(F.min("tree").alias("tree"))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups, a few at a time, of batches sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        tail = np.ones(len(pdf), bool)
        for k in keys:
            tail &= pdf[k].to_numpy() == pdf[k].iloc[-1]
        cut = int(len(pdf) - tail[::-1].argmin()) if not tail.all() else 0
        if held and (cut or any(held[0][k].iloc[0] != pdf[k].iloc[0] for k in keys)):
            yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


_BLOCK = ["region", "chunk", "block"]


class _Region:
    """Rows of one region, or of one block of a large one, with their sketches.

    ``role`` 0 rows are asked, 1 ask, 2 do both. Rows of the region's largest component ask
    nobody; of two other components the one of the larger number asks, so that each pair
    across components is looked at from one side only.
    """

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        self.who, self.com, self.role = (rows[c].to_numpy() for c in ("id", "component", "role"))
        self.top, self.tree = int(rows["top"].iloc[0]), int(rows["tree"].iloc[0])
        self.sketches = Sketches(rows["n"].to_numpy(), rows["bits"].tolist())
        self.homes = np.frombuffer(b"".join(rows["homes"]), np.int64).reshape(len(rows), TREES)

    def candidates(self, unseen: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (x, y, share that differs) across components that no bound excludes, a few
        askers at a time; with ``unseen`` only those that no earlier tree's region has."""
        asked = np.flatnonzero(self.role != 1)
        asks = np.flatnonzero((self.role != 0) & (self.com != self.top))
        com = self.com[asked]
        for i in range(0, len(asks), 128):
            mine = self.com[asks[i : i + 128], None]
            x, y = np.nonzero((com != mine) & ((com == self.top) | (com < mine)))
            x, y = asks[i + x], asked[y]
            ok, share = self.sketches.possible(x, y)
            x, y = x[ok], y[ok]
            if unseen and len(x):
                new = ~(self.homes[x, : self.tree] == self.homes[y, : self.tree]).any(1)
                x, y, share = x[new], y[new], share[new]
            if len(x):
                yield x, y, share


def _regions(batches: Iterator[pd.DataFrame]) -> Iterator[_Region]:
    for pdf in _groups(batches, _BLOCK):
        key = pdf[_BLOCK].to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        for s, e in zip(cut, np.r_[cut[1:], len(pdf)]):
            if e - s > 1:
                yield _Region(pdf.iloc[s:e])


def _likeliest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each asker with the NEXT rows of other components that may be most alike."""
    for region in _regions(batches):
        who = region.who
        for x, y, share in region.candidates(False):
            order = np.lexsort((who[y], share, x))
            x, y = x[order], y[order]
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            at = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
            x, y = who[x[at < NEXT]], who[y[at < NEXT]]
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


_INVOLVED = [*_BLOCK, "tree", "role", "id", "n", "component", "top"]


def _involved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of regions that still have candidates."""
    for region in _regions(batches):
        used = np.zeros(len(region.who), bool)
        for x, y, _ in region.candidates(True):
            used[x] = used[y] = True
        if used.any():
            yield region.rows.loc[used, _INVOLVED]


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between a region's components, every candidate that is left being confirmed on the
    whole sets, the likeliest first; a pair that links found here join already is passed over."""
    for region in _regions(batches):
        who, com, texts = region.who, region.com.tolist(), region.rows["text"].tolist()
        sets: dict[int, np.ndarray] = {}
        root = {c: c for c in com}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for x, y, share in region.candidates(True):
            order = np.lexsort((who[y], who[x], share))
            for i, j in zip(x[order].tolist(), y[order].tolist()):
                a, b = top(com[i]), top(com[j])
                if a == b:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingles((texts[k] or "").encode("utf-8", "replace"))
                if linked(sets[i], sets[j]):
                    root[max(a, b)] = min(a, b)
                    found.append((who[i], who[j]))
        if found:
            yield pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that sizes and sketches do not exclude."""
    for pdf in batches:
        k = len(pdf)
        sketches = Sketches(np.r_[pdf["na"].to_numpy(), pdf["nb"].to_numpy()], [*pdf["bits_a"], *pdf["bits_b"]])
        ok, _ = sketches.possible(np.arange(k), np.arange(k, 2 * k))
        yield pdf.iloc[ok][["a", "b"]]


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sets' sizes and sketches do not prove to be no links."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(_possible, "a long, b long")


def _confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole-set similarity of pairs: rows (a, chunk, id, text), the row of ``a`` itself first."""
    current, base = None, None
    for pdf in batches:
        a, b, ok = [], [], []
        for x, chunk, i, text in zip(pdf["a"], pdf["chunk"], pdf["id"], pdf["text"]):
            u = shingles((text or "").encode("utf-8", "replace"))
            if (x, chunk) != current:
                current, base = (x, chunk), u
                if x == i:
                    continue
            a.append(x)
            b.append(i)
            ok.append(linked(base, u))
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "linked": np.array(ok, bool)})


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) among distinct pairs a < b, by the whole texts ``(id, text)``.

    Pairs are gathered beside their smaller id in chunks, so an id with many partners is
    met by many tasks; a text travels once for each pair.
    """
    with scratch() as keep:
        pairs = keep(materialise(pairs))
        if pairs.isEmpty():
            return pairs
        ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        some = materialise(texts.join(broadcast_if_small(ids, ids.count()), "id"))
        chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        dealt = pairs.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
        others = dealt.select("a", "chunk", F.col("b").alias("id")).join(some, "id").select("a", "chunk", "id", "text", F.lit(1).alias("k"))
        selves = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        selves = selves.join(some.withColumnRenamed("id", "a"), "a").select("a", "chunk", F.col("a").alias("id"), "text", F.lit(0).alias("k"))
        rows = others.unionByName(selves).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "k")
        out = rows.select("a", "chunk", "id", "text").mapInPandas(_confirmed, "a long, b long, linked boolean")
        return keep(run_on_texts(out.filter("linked").select("a", "b")))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (region, tree, id, n, component) of regions that lie in several components, as
    ``_Region`` takes them; a large region is dealt to blocks of those asked, each met by
    chunks of those that ask, so a region that one component fills but for a few costs little
    more than its rows."""
    per = rows.groupBy("region", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    per = per.groupBy("region").agg(
        F.max_by("component", F.struct("rows", -F.col("component"))).alias("top"), F.count("*").alias("kinds"),
        F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.sum("size").alias("size"),
    )
    parts = lambda rows: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(F.col("size") * rows / F.col("rows") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    per = per.filter("kinds > 1").select("region", "top", parts(F.col("rows")).alias("blocks"), parts(F.col("rows") - F.col("most")).alias("chunks"))
    per = materialise(per)
    mine = rows.join(broadcast_if_small(per, per.count()), "region")
    role = lambda k: F.lit(k).alias("role")
    one = F.array(F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("block"), role(2)))
    spot = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(parts)).cast("int")
    asked = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), spot("blocks", 1).alias("block"), role(0)))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(spot("chunks", 2).alias("chunk"), b.alias("block"), role(1)))
    spots = F.when(F.col("blocks") * F.col("chunks") == 1, one).otherwise(F.when(F.col("component") == F.col("top"), asked).otherwise(F.concat(asked, asks)))
    return mine.select("region", "tree", "id", "n", "component", "top", F.inline(spots))


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, key of each row of (id, text); a row with id, n, homes, deep, bits for each
    distinct non-empty set)."""
    rows = run_on_texts(docs.mapInPandas(_signed, "id long, n long, key string, homes binary, deep binary, bits binary"))
    some = rows.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "homes", "deep", "bits")])
    return rows.select("id", "n", "key"), materialise(some)


def link_sets(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of the representatives that are linked with another one."""
    sets = classes.select("id", "n", "bits", "homes")
    regions = classes.select("id", "n", "homes", "deep").mapInPandas(_placed, "tree int, region long, deep binary, id long, n long")
    regions = materialise(regions)
    shared = regions.groupBy("region").agg(F.count("*").alias("rows")).filter("rows > 1")
    regions = materialise(regions.join(shared, "region"))
    pairs = materialise(neighbours(regions))
    comp = materialise(components(confirm(possible(pairs.filter(F.col("tree") < FIRST_TREES), sets), texts)))

    def with_component(rows: DataFrame, key: str) -> DataFrame:
        mine = comp.select(F.col("id").alias(key), F.col("component").alias(f"_{key}"))
        return rows.join(mine, key, "left").withColumn(f"_{key}", F.coalesce(f"_{key}", key))

    def grown(links: DataFrame) -> DataFrame:
        """The components with further links."""
        if links.isEmpty():
            return comp
        return materialise(components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)))

    def blocks(deepen: bool) -> DataFrame:
        """Rows of regions that lie in several components still, sorted by block."""
        mine = with_component(regions, "id").withColumnRenamed("_id", "component")
        if deepen:
            mine = mine.withColumn("region", F.when(F.col("rows") > CROWD, F.xxhash64("region", "deep")).otherwise(F.col("region")))
        rows = dealt(mine.drop("rows", "deep")).join(sets.drop("n"), "id")
        return rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)

    across = with_component(with_component(pairs.filter(F.col("tree") >= FIRST_TREES), "a"), "b").filter("_a <> _b")
    comp = grown(confirm(possible(across, sets), texts))
    with small_batches(texts.sparkSession):
        pairs = materialise(blocks(True).mapInPandas(_likeliest, "a long, b long").distinct())
    comp = grown(confirm(pairs, texts))
    kind = "region long, chunk int, block int, tree int, role int, id long, n long, component long, top long"
    left = materialise(blocks(False).mapInPandas(_involved, kind))
    if left.isEmpty():
        return comp
    ids = materialise(left.select("id").distinct())
    some = texts.join(broadcast_if_small(ids, ids.count()), "id")
    rows = left.join(some.join(sets.drop("n"), "id"), "id").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    return grown(run_on_texts(rows.mapInPandas(_settled, "a long, b long")))


def _one_text(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(id, text) with one row an id, the greatest text of an id that repeats, null ids apart;
    and whether an id repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    known = rows.filter("id is not null")
    again = bool(known.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count())
    if again:
        rows = known.groupBy("id").agg(F.max("text").alias("text")).unionByName(rows.filter("id is null"))
    return rows, again


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents with equal shingle sets are one class. Each tree of the forest sorts the
    classes by signature values of its own. A class's neighbours in a tree's order are those
    with the longest common prefix; the ones of the first trees are confirmed on the whole
    sets, then those of the others that still lie in different components. What is linked
    by then leaves most regions (shared prefixes of LEAST values) in one component; those
    are done. In the others every pair across components is a candidate, of which only
    those go that a bound on their sets proves to be no links: crowded regions are first
    looked at DEPTH deep, each outsider asking its likeliest partners; last, every candidate
    that is left in a region is confirmed beside its texts, in the first tree that has it.

    Texts without words, null ones included, link with nothing and have size 0. Rows that
    share a doc_id count as one document with the greatest of their texts, and each gets that
    document's row. Rows with null ids link with nothing and are kept. An empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    with scratch() as keep:
        base, again = _one_text(docs)
        rows, classes = classes_of(base)
        comp = link_sets(base.filter("id is not null"), classes)
        per = classes.select(F.col("key").alias("_key"), "id").join(comp, "id", "left").select("_key", F.coalesce("component", "id").alias("_c"))
        mine = rows.withColumn("_k", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("key")))
        out = mine.join(per, mine["_k"] == per["_key"], "left").select("id", "n", F.coalesce("_c", "id").alias("_c"))
        if again:
            ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null")
            out = ids.join(out, "id").unionByName(out.filter("id is null"))
        out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_c").alias("component_id"), F.col("id").eqNullSafe(F.col("_c")).alias("kept"))
        return keep(materialise(out))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id, with all
    columns of ``docs`` and no others, whatever their names.

    Of rows that share a doc_id, whose texts may differ, the one with the greatest text stays
    (of equal ones any one). Rows with null ids, and texts without words, are in no group and
    stay. An empty table gives no rows.
    """
    _, again = _one_text(docs)
    lost = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(whole_rows(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    if again:
        first = F.max_by("row", F.struct(F.col("text").isNotNull(), "text")).alias("row")
        rows = rows.filter("id is not null").groupBy("id").agg(first).unionByName(rows.filter("id is null").select("id", "row"))
    return rows.join(lost, "id", "left_anti").select("row.*")


def op8_minhash_forest(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
