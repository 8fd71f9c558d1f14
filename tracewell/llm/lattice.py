"""Embedding near-duplicates: hashing to the E8 lattice with neighbouring cells probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, materialise, table

THRESHOLD = 0.9
#: Hash tables; each joins BLOCKS lattice points of 8 projected dimensions to a cell.
TABLES, BLOCKS = 7, 2
#: Stretch of the unit vectors' projections before decoding (lattice points are 1.41 apart).
SCALE = 1.2
#: Neighbouring cells probed in each table.
PROBES = 8
#: Rows of a cell that are compared as one block; larger cells are dealt to pairs of blocks.
BLOCK_ROWS = 2048


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``x``, doubled so that they are integers."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1) % 2)
        if len(odd):
            e = y[odd] - r[odd]
            k = np.abs(e).argmax(1)
            r[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near_b = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
    return np.where(near_b[:, None], 2 * b, 2 * a).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: two coordinates of 2 in size, or eight of 1
    with an even number of minus signs."""
    two = [(i, j, a, b) for i in range(8) for j in range(i) for a in (2, -2) for b in (2, -2)]
    out = np.zeros((len(two), 8), np.int64)
    for k, (i, j, a, b) in enumerate(two):
        out[k, i], out[k, j] = a, b
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.vstack([out, signs[(signs < 0).sum(1) % 2 == 0]])


class Lattice:
    """Cells of unit vectors of ``dim`` components in every table, from a seed alone."""

    def __init__(self, dim: int, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.probes, self.tables, self.blocks = probes, tables, blocks
        gauss = rng.standard_normal((tables, dim, 8 * blocks))
        if dim >= 8 * blocks:
            gauss = np.linalg.qr(gauss)[0] * np.sqrt(dim)
        self.projections = gauss * scale / np.sqrt(8)
        self.mix = rng.integers(1, 2**62, (blocks, 8), dtype=np.int64) * 2 + 1
        self.steps = minimal_vectors()

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) cell numbers, the own cell first."""
        n = len(unit)
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        half = self.steps / 2.0
        for t in range(self.tables):
            x = (unit @ self.projections[t]).reshape(n, self.blocks, 8)
            home = np.zeros(n, np.int64)
            far, code = [], []
            for b in range(self.blocks):
                c = decode_e8(x[:, b])
                home += (c * self.mix[b]).sum(1)
                rest = x[:, b] - c / 2.0
                # squared distance to the neighbour, less that to the own point
                far.append(2.0 - 2.0 * rest @ half.T)
                code.append(np.broadcast_to((self.steps * self.mix[b]).sum(1), (n, len(self.steps))))
            far, code = np.hstack(far), np.hstack(code)
            best = np.argpartition(far, self.probes, axis=1)[:, : self.probes]
            out[:, t, 0] = home
            out[:, t, 1:] = home[:, None] + np.take_along_axis(code, best, 1)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _by_dim(vectors: pd.Series, dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length among packed vectors."""
    size = np.dtype(dtype).itemsize
    dims = vectors.map(len).to_numpy() // size
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, np.frombuffer(b"".join(vectors.iloc[at]), dtype).reshape(len(at), d)


def _numbered(cells: np.ndarray, dim: int) -> np.ndarray:
    """Cell numbers told apart by table and dimension."""
    t = np.arange(cells.shape[1], dtype=np.int64)[None, :, None]
    with np.errstate(over="ignore"):
        x = (cells ^ (t * 1000003 + dim)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _placed(dtype: str, options: dict, full: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices: dict[int, Lattice] = {}
        for pdf in batches:
            for at, rows in _by_dim(pdf["v"], dtype):
                d = rows.shape[1]
                lattice = lattices.setdefault(d, Lattice(d, **options))
                for i in range(0, len(at), 2048):
                    part = at[i : i + 2048]
                    cells = _numbered(lattice.cells(_unit(rows[i : i + 2048])), d)
                    n, tables, per = cells.shape
                    if not full:
                        yield pd.DataFrame({"cell": cells.reshape(-1)})
                        continue
                    src = np.repeat(part, tables * per)
                    yield pd.DataFrame({
                        "cell": cells.reshape(-1),
                        "t": np.tile(np.repeat(np.arange(tables, dtype=np.int32), per), n),
                        "home": np.tile(np.arange(per) == 0, n * tables),
                        "id": pdf["id"].to_numpy()[src], "w": pdf["w"].to_numpy()[src], "v": pdf["v"].to_numpy()[src],
                    })

    return run


def _pairs(starts: np.ndarray, ends: np.ndarray, i: np.ndarray, limit: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``i`` against all rows of their groups, in pieces of about ``limit`` pairs."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        n = sizes[a:b]
        left = np.repeat(i[a:b], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[a:b], n)
        yield left, right
        a = b


def _seen(ci: np.ndarray, cj: np.ndarray) -> np.ndarray:
    """Pairs of which one's own cell is among the other's cells of a table."""
    return (ci[:, :1] == cj).any(1) | (cj[:, :1] == ci).any(1)


def _linked(dtype: str, threshold: float, options: dict):
    """Counts of links and spanning edges of the rows of whole cells, each link counted once."""

    def links(pdf: pd.DataFrame, lattice: Lattice) -> Iterator[pd.DataFrame]:
        rows = np.frombuffer(b"".join(pdf["v"]), dtype).reshape(len(pdf), -1)
        unit = _unit(rows)
        key = pdf["cell"].to_numpy()
        pair = pdf["pair"].to_numpy()
        t, home, ids, w, side = (pdf[c].to_numpy() for c in ("t", "home", "id", "w", "side"))
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
        size = np.diff(np.r_[cut, len(key)])
        group = np.repeat(np.arange(len(cut)), size)
        at = np.flatnonzero(home & (size[group] > 1))
        left, right = [], []
        for i, j in _pairs(cut[group[at]], (cut + size)[group[at]], at):
            # two own rows meet once; a pair of blocks compares across, a block with itself inside
            ok = (ids[i] != ids[j]) & (~home[j] | (ids[i] < ids[j])) & ((side[i] != side[j]) | (side[i] == 2))
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            left.append(i[near])
            right.append(j[near])
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        if not len(i):
            return
        used, back = np.unique(np.r_[i, j], return_inverse=True)
        cells = _numbered(lattice.cells(unit[used]), unit.shape[1])
        ii, jj = back[: len(i)], back[len(i) :]
        keep = np.ones(len(i), bool)
        for k in range(lattice.tables):  # an earlier table has the pair
            ask = np.flatnonzero(keep & (t[i] > k))
            keep[ask[_seen(cells[ii[ask], k], cells[jj[ask], k])]] = False
        # the same table may have it in the other's own cell: the smaller id's cell comes first
        ask = np.flatnonzero(keep)
        a, b = np.where(ids[i[ask]] < ids[j[ask]], ii[ask], jj[ask]), np.where(ids[i[ask]] < ids[j[ask]], jj[ask], ii[ask])
        tt = t[i[ask]]
        first = (cells[a, tt, :1] == cells[b, tt]).any(1)
        place = np.where(first, cells[a, tt, 0], cells[b, tt, 0])
        keep[ask[place != key[i[ask]]]] = False
        i, j = i[keep], j[keep]
        if not len(i):
            return
        who, at = np.unique(np.r_[ids[i], ids[j]], return_inverse=True)
        count = np.zeros(len(who), np.int64)
        np.add.at(count, at, np.r_[w[j], w[i]])
        label, x, y = np.arange(len(who)), at[: len(i)], at[len(i) :]
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pd.DataFrame({"a": who, "b": who[label], "n": count})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices: dict[int, Lattice] = {}
        size = np.dtype(dtype).itemsize

        def ready(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            dims = pdf["v"].map(len).to_numpy() // size
            for d in np.unique(dims):
                part = pdf[dims == d].reset_index(drop=True)
                yield from links(part, lattices.setdefault(int(d), Lattice(int(d), **options)))

        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            # the last cell may go on in the next batch
            tail = (pdf["cell"] == pdf["cell"].iloc[-1]) & (pdf["pair"] == pdf["pair"].iloc[-1])
            held = pdf[tail]
            done = pdf[~tail]
            if len(done):
                yield from ready(done.reset_index(drop=True))
        if held is not None and len(held):
            yield from ready(held.reset_index(drop=True))

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """Links of cosine >= ``threshold`` between vectors, by E8 lattice hashing.

    Every distinct vector enters its own cell and the nearest neighbouring cells of each
    table; a cell compares the vectors whose own cell it is with all that entered, by cosine
    in double precision. A link is counted in the first table and cell that can find it, so
    counts need no list of pairs; cells hand on counts and spanning edges only. Cells with
    more than ``block_rows`` rows are dealt to pairs of blocks.

    Returns id, n_links (others linked directly, copies included), component_id, kept, one
    row for each row of ``vectors``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different lengths don't link. Rows
    with null ids are their own component of null. Other columns are ignored. Pairs near the
    threshold can be missed with a small chance (see the README for measured recall).
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype, code = ("<f4", "f") if element == "float" else ("<f8", "d")
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(element)).otherwise(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("v", F.when(good & F.col("id").isNotNull(), plain))
    key = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)
    named = rows.select("id", F.when(F.col("v").isNotNull(), key).alias("key"))
    classes = rows.filter("v is not null").withColumn("key", key).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v"))

    def packed(batches):
        for pdf in batches:
            pdf["v"] = [np.asarray(v, dtype).tobytes() for v in pdf["v"]]
            yield pdf

    classes = materialise(classes.mapInPandas(packed, "key string, id long, w long, v binary"))
    small = classes.select("id", "w", "v")
    full = small.mapInPandas(_placed(dtype, options, True), "cell long, t int, home boolean, id long, w long, v binary")
    count = small.mapInPandas(_placed(dtype, options, False), "cell long").groupBy("cell").agg(F.count("*").alias("rows"))
    large = materialise(count.filter(F.col("rows") > block_rows).select("cell", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")))
    n_large = large.count()
    one = full.join(F.broadcast(large.select("cell")), "cell", "left_anti") if 0 < n_large <= 100_000 else full.join(large.select("cell"), "cell", "left_anti") if n_large else full
    one = one.withColumn("pair", F.lit(0)).withColumn("side", F.lit(2))
    if n_large:
        many = full.join(F.broadcast(large) if n_large <= 100_000 else large, "cell")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        many = many.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lo, hi = F.least("_b", "_o"), F.greatest("_b", "_o")
        side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
        many = many.withColumn("pair", lo * F.col("blocks") + hi + 1).withColumn("side", side)
        one = one.unionByName(many.select(*one.columns))
    one = one.repartition("cell", "pair").sortWithinPartitions("cell", "pair")
    found = materialise(one.mapInPandas(_linked(dtype, threshold, options), "a long, b long, n long"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    comps = components(found.filter("a <> b").select("a", "b"))
    per = classes.select("key", "id", "w").join(counts, "id", "left").join(comps, "id", "left")
    per = per.select(F.col("key").alias("_key"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = named.join(per, named["key"] == per["_key"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op3_e8_lattice(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"))
