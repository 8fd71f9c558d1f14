"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, broadcast_if_small, materialise, scratch, table, whole_rows

#: Weights of the sources in code point order, repeating (fixed by the query's contract).
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MAX_EPOCHS = 3
#: Bins of a two-level prefix sum; each bin is summed on its own, then the bins.
BINS = 4096
#: Queued documents that are ordered in one task to find the cut; a larger bin is divided again.
CUT_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(doc_id: Column, seed: int) -> Column:
    """Place in the shuffled order: 60 bits of an MD5, which other engines can state too."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: its size, weight and target, from ``(source, size)`` rows.

    Targets share all words by weight; none exceeds ``cap`` times its source. The excess is
    shared again by weight until none is above, which is the level L with
    sum(min(cap * size, L * weight)) = all words. Only one row a source takes part in the
    ordered sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", picked).withColumn("limit", F.col("source_size") * float(cap))
    everything = Window.partitionBy(F.lit(1))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the first source, by limit / weight, that stays under its limit fixes the level
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    per = per.withColumn("level", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _running(rows: DataFrame, bins: int) -> DataFrame:
    """Running words of each source in its shuffled order, in two levels: within a bin of the
    order, then over the bins' sums. No source's rows have to meet in one task."""
    width = bins.bit_length() - 1
    rows = rows.withColumn("_bin", F.shiftright("_h", 60 - width))
    sums = rows.groupBy("_key", "_bin").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_bin", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_key", "_bin").orderBy("_h", "doc_id", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_run", F.sum("size").over(inner)).join(sums, ["_key", "_bin"])
    return rows.withColumn("_cum", F.col("_run") + F.col("_base")).drop("_bin", "_run", "_base")


def _cut(queue: DataFrame, budget: float, bins: int) -> tuple | None:
    """(_v, _h, doc_id, _t) of the first queued document that does not fit; None if all fit.

    The bin of finish times that crosses the budget is divided into bins again until few
    documents are left, of equal times by their place in the shuffled order; only those few
    are put in order.
    """
    # nothing after a finish time of 1 by more than one document can be taken; later ones share a bin
    ranges = [(F.least("_v", F.lit(1.5)), 0.0, 1.5000001), (F.col("_h").cast("double"), 0.0, 2.0**60)]
    inside, base = queue, 0
    for value, lo, hi in ranges:
        while hi - lo > 1e-12 * max(1.0, hi):
            width = (hi - lo) / bins
            spot = F.least(F.greatest(F.floor((value - lo) / width), F.lit(0)), F.lit(bins - 1))
            per = inside.groupBy(spot.alias("_bin")).agg(F.sum("size").alias("_s"), F.count("*").alias("_n"))
            until = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            crossing = per.withColumn("_to", F.sum("_s").over(until) + F.lit(base)).filter(F.col("_to") > budget).orderBy("_bin").first()
            if crossing is None:
                return None
            base = crossing["_to"] - crossing["_s"]
            inside = inside.filter(spot == crossing["_bin"])
            if crossing["_n"] <= CUT_ROWS:
                break
            lo, hi = lo + crossing["_bin"] * width, lo + (crossing["_bin"] + 1) * width
        else:
            continue
        break
    order = Window.orderBy("_v", "_h", "doc_id", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_total", F.sum("size").over(order) + F.lit(base))
    return inside.filter(F.col("_total") > budget).agg(F.min(F.struct("_v", "_h", "doc_id", "_t")).alias("c")).first()["c"]


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_EPOCHS, seed: int = 17, bins: int = BINS) -> DataFrame:
    """Weighted fair queue over all documents.

    Every source queues its documents in a shuffled order, again for each epoch up to
    ``cap``. A queued document's virtual finish time is the source's words up to and
    including it, divided by the source's target. The queue is ordered globally by finish
    time and cut at the total budget (the sum of the targets); what comes whole before the
    cut is taken, so all sources advance at the same share of their targets. The cut is
    found by range: words by bin of finish time, then within the bin that crosses the budget.

    Returns doc_id, size, source_size, target, taken, and source and copies (times taken).
    Null texts have size 0; null sources form one source, last in order; a document of size
    0 is taken with 0 words; repeated doc_ids are separate rows; an empty table gives no
    rows; other columns, whatever their names, are ignored. The order depends on doc_id, size
    and a hash of the text only, so reruns agree.
    """
    return _mixed(docs, weights, cap, seed, bins).drop("_t")


def _mixed(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_EPOCHS, seed: int = 17, bins: int = BINS) -> DataFrame:
    with scratch() as keep:
        key = F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), "source"))
        rows = docs.select(
            "doc_id", "source", key.alias("_key"), word_count(F.col("text")).alias("size"),
            shuffled(F.col("doc_id"), seed).alias("_h"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"),
        )
        rows = materialise(rows)
        targets = materialise(source_targets(rows.select(F.col("_key").alias("source"), "size"), weights, cap).withColumnRenamed("source", "_key"))
        rows = keep(materialise(_running(rows, bins).join(broadcast_if_small(targets, targets.count(), 10_000), "_key")))
        finish = lambda e: (e * F.col("source_size") + F.col("_cum")) / F.greatest("target", F.lit(1e-9))
        queue = rows.filter("target > 0").withColumn("_v", F.explode(F.array(*[finish(F.lit(e)) for e in range(cap)])))
        budget = targets.agg(F.round(F.sum("target"), 3)).first()[0] or 0.0
        cut = _cut(queue, budget, bins)
    if cut is None:  # all that is queued fits
        copies = F.when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0))
    else:
        first_out = F.struct(F.lit(cut[0]).alias("_v"), F.lit(cut[1]).alias("_h"), F.lit(cut[2]).cast("long").alias("doc_id"), F.lit(cut[3]).alias("_t"))
        each = [F.when(F.struct(finish(F.lit(e)).alias("_v"), "_h", F.col("doc_id").cast("long").alias("doc_id"), "_t") < first_out, 1).otherwise(0) for e in range(cap)]
        copies = F.when(F.col("target") > 0, sum(each[1:], each[0])).otherwise(F.lit(0))
    return rows.withColumn("copies", copies.cast("long")).select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "_t",
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` as the mix takes them: whole rows with all their columns and no
    others, whatever their names, one row for each time taken.

    Rows that agree in doc_id, source and text are told apart by number, so none is lost.
    Null texts, ids and sources are treated as ``mix`` states; an empty table gives no rows.
    """
    ident = ["doc_id", "source", "_t"]
    plan = _mixed(docs, **options).select(*ident, "copies")
    number = Window.partitionBy(*ident).orderBy("copies")
    plan = plan.withColumn("_k", F.row_number().over(number)).filter("copies > 0").withColumnsRenamed({c: f"_p_{c}" for c in [*ident, "_k"]})
    mine = docs.select(whole_rows(docs).alias("row"), "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    mine = mine.withColumn("_k", F.row_number().over(Window.partitionBy(*ident).orderBy(F.lit(1))))
    same = F.lit(True)
    for c in [*ident, "_k"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    out = mine.join(plan, same)
    return out.withColumn("_e", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10_weighted_fair_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
