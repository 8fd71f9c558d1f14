"""Order MinHash fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SEPARATOR, bounds_of, bucket_of, table

#: Slots of a fingerprint, a power of two: the k-mers' hashes are dealt to the slots.
SLOTS = 32
#: K-mers kept in a slot, in text order.
TUPLE = 2
#: Words in a k-mer; the last ones are filled up with empty words, so n words give n k-mers.
K = 2
#: Bits of a place beside a hash of 40 bits in one number, for texts of fewer than NARROW
#: words; longer texts keep hash and place apart.
_PLACE = 24
NARROW = 1 << 23
_BITS = 5
#: Rows of the table of neighbouring buckets at most, bounds among them, and rows in a bucket.
MAX_BUCKETS, MAX_BOUNDS, BUCKET_ROWS = 1 << 20, 1024, 64


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and use it, bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text as SLOTS groups of 8 hex digits (``--------``: empty slot).

    Order MinHash: every k-mer is numbered by its earlier occurrences; numbered k-mers are
    hashed and dealt to slots; each slot keeps the TUPLE least, in the order in which they
    stand in the text, and hashes them. A null text counts as empty: all slots are empty.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda w: w != "")
    kmer = lambda w, x, i: F.xxhash64(x, *[F.coalesce(F.get(w, i + j), F.lit("")) for j in range(1, K)])
    mask = F.lit((1 << 64 - _PLACE) - 1)

    def build(w: Column, pack, hash_of, place_of, steps: int) -> Column:
        """The signature, with k-mers as ``pack(hash of 40 bits, signed; place)``, which sorts by
        hash, then place."""

        def numbered(s: Column) -> Column:
            same = lambda i, x, back: F.coalesce(hash_of(F.get(s, i - back)) == hash_of(x), F.lit(False))
            # equal hashes stand together: the number of equal ones before is found by halving
            halves = F.array(*[F.lit(1 << b) for b in range(steps - 1, -1, -1)])

            def earlier(x: Column, i: Column) -> Column:
                search = F.aggregate(halves, F.lit(0), lambda n, b: F.when((i >= n + b) & same(i, x, n + b), n + b).otherwise(n))
                return F.when(same(i, x, F.lit(1)) & (i > 0), search).otherwise(F.lit(0))

            return F.sort_array(F.transform(s, lambda x, i: pack(F.shiftright(F.xxhash64(hash_of(x), earlier(x, i)), _PLACE), place_of(x))))

        slot = lambda x: F.shiftrightunsigned(hash_of(x), 40 - _BITS).bitwiseAND(F.lit(SLOTS - 1))
        least = lambda e: F.filter(e, lambda x, i: (i < TUPLE) | (slot(x) != slot(F.get(e, i - TUPLE))))

        def signature(e: Column) -> Column:
            def one(j: Column) -> Column:
                # in text order: the place leads
                own = F.sort_array(F.transform(F.filter(e, lambda x: slot(x) == j), lambda x: F.struct(place_of(x).alias("p"), hash_of(x).bitwiseAND(mask).alias("h"))))
                return F.when(F.size(own) == 0, "-" * 8).otherwise(F.lpad(F.right(F.hex(F.xxhash64(F.transform(own, lambda x: x["h"]))), F.lit(8)), 8, "0"))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda j: one(j)), "")

        first = F.sort_array(F.transform(w, lambda x, i: pack(F.shiftright(kmer(w, x, i), _PLACE), i.cast("long"))))
        return _bind(first, lambda s: _bind(numbered(s), lambda e: _bind(least(e), signature)))

    def narrow(w: Column) -> Column:
        pack = lambda h, p: F.shiftleft(h, _PLACE).bitwiseOR(p)
        return build(w, pack, lambda x: F.shiftright(x, _PLACE), lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)), _PLACE)

    def wide(w: Column) -> Column:
        pack = lambda h, p: F.struct(h.alias("h"), p.alias("p"))
        return build(w, pack, lambda x: x["h"], lambda x: x["p"], 31)

    return F.lower(_bind(words, lambda w: F.when(F.size(w) < NARROW, narrow(w)).otherwise(wide(w))))


def likeness(a: Column, b: Column) -> Column:
    """Equal slots among those filled in either; 1 for two empty fingerprints, null if one is null."""
    part = lambda c, j: F.substring(c, j * 8 + 1, F.lit(8))
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    empty = "-" * 8
    filled = F.filter(slots, lambda j: (part(a, j) != empty) | (part(b, j) != empty))
    equal = F.filter(slots, lambda j: (part(a, j) == part(b, j)) & (part(a, j) != empty))
    return F.when(a == b, 1.0).otherwise(F.size(equal) / F.greatest(F.size(filled), F.lit(1)))


def _bucket(docs: DataFrame, parts: int) -> Column:
    """Bucket of a row (doc_id, _h), descending in the order of ``neighbours``: ranges of doc_id of
    about equal rows, by quantiles, each divided evenly; null ids, and an id that fills
    several ranges, by their hash."""
    bounds = bounds_of(docs, "doc_id", min(parts, MAX_BOUNDS))
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    edges = [ends["lo"] or 0, *bounds, (ends["hi"] or 0) + 1]
    inner = max(1, -(-parts // max(1, len(edges) - 1)))
    i = F.col("doc_id")
    k = bucket_of(i, bounds)
    known = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<decimal(20,0)>")
    low, high = F.get(known, k), F.get(known, k + 1)
    # in decimals: the width of a range of longs can exceed a long
    part = F.least(F.floor((i - low) * inner / F.greatest(high - low, F.lit(1))), F.lit(inner - 1))
    by_hash = F.shiftright("_h", 52) + 2048
    heavy = sorted({b for b, c in zip(bounds, bounds[1:]) if b == c})
    minor = F.when(i.isin(*heavy), 4095 - by_hash).otherwise(4096) if heavy else F.lit(4096)
    return F.when(i.isNull(), -1 - by_hash).otherwise((k * inner + part) * 4097 + minor).cast("long")


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document with the text and fingerprint of the next one, descending doc_id (null ids
    last; rows of one id by a hash of the text; after the last, the first). Rows are dealt to
    ranges of that order of about equal rows; each range is ordered in its own task, and the
    ranges' last rows get the head of the range that follows. A single row is its own
    neighbour; an empty table gives no rows; other columns, whatever their names, are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    parts = max(1, min(MAX_BUCKETS, docs.count() // BUCKET_ROWS))
    docs = docs.withColumn("_bucket", _bucket(docs, parts))
    rows = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    place = F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("i"), F.col("_h"))
    # the head of each range: one row for each of a bounded number of ranges
    tops = docs.groupBy("_bucket").agg(F.min(place).alias("_top"))
    down = Window.orderBy(F.col("_bucket").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.struct("_bucket", "_top")
    wanted = tops.select(F.col("_bucket").alias("_for"), F.coalesce(F.lead(head).over(down), F.first(head).over(whole)).alias("_want"))
    heads = docs.join(F.broadcast(wanted), (F.col("_bucket") == F.col("_want._bucket")) & place["i"].eqNullSafe(F.col("_want._top.i")) & (F.col("_h") == F.col("_want._top._h")))
    # equal rows: any of them
    heads = heads.withColumn("_first", F.row_number().over(Window.partitionBy("_for").orderBy("_h"))).filter("_first = 1")
    heads = heads.select(F.col("_for").alias("_bucket"), F.col("text").alias("_head"), fingerprint(F.col("text")).alias("_head_fp"))
    both = rows.join(heads.hint("merge"), "_bucket", "left")
    w = Window.partitionBy("_bucket").orderBy(F.col("doc_id").desc_nulls_last(), "_h")
    both = both.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    both = both.withColumn("_next", F.lead("text").over(w)).withColumn("_next_fp", F.lead("fingerprint").over(w))
    pick = lambda a, b: F.when(F.col("_last"), F.col(a)).otherwise(F.col(b))
    return both.select("doc_id", "text", "fingerprint", pick("_head", "_next").alias("next_text"), pick("_head_fp", "_next_fp").alias("next_fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside those of its edited text (the last third replaced by
    the head of the next document) and of the next document, with their likeness. Null texts
    count as empty; see ``neighbours`` for ties, null ids and empty tables."""
    rows = neighbours(docs)
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.char_length(text)
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - cut), F.substring(after, F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("*", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("_edited")).alias("edited_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_order_minhash(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
