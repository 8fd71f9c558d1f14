"""Secret scanning over an incremental blob ledger, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import materialise, scratch, table, whole_rows

#: Version of the rules below; a ledger row holds for one blob under one version.
RULE_VERSION = "1"
#: kind, pattern, in the order that breaks ties. The first three are the contract's base
#: rules: a pattern with a minimum length finds what the unbounded one finds and then keeps,
#: as its runs are maximal; the assignment's value is measured afterwards.
RULES = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: The assignment's value, group 2 of the contract's rule, at the end of its match.
_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
MIN_VALUE = 8

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _spans(text: Column, rank: int) -> Column:
    """Spans (start, rank, end) of a rule in code points, leftmost and non-overlapping.

    The text between matches and the matches alternate, so running lengths give places.
    """
    kind, pattern = RULES[rank]
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long_enough = F.transform(hits, lambda h: F.char_length(F.regexp_extract(h, _VALUE, 1)) >= MIN_VALUE if kind == "assign" else F.lit(True))
    pieces = F.arrays_zip(gaps.alias("gap"), F.transform(hits, lambda h: F.char_length(h)).alias("hit"), long_enough.alias("ok"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(T.ArrayType(SPAN)).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + p["hit"]).alias("end"))
        kept = F.when(p["hit"].isNotNull() & p["ok"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((begin + F.coalesce(p["hit"], F.lit(0))).alias("at"), kept.alias("spans"))

    found = F.aggregate(pieces, start, step, lambda acc: acc["spans"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(T.ArrayType(SPAN)))


def scan_text(text: Column) -> Column:
    """All spans of a text, by start, then rule, as array<struct<start, rank, end>>."""
    return F.sort_array(F.concat(*[_spans(text, k) for k in range(len(RULES))]))


def blob_id(text: Column) -> Column:
    """Content address of a version: SHA-256 of its UTF-8; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, path: str = "doc_id", ledger: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan every historical version once and join what is found back to all its paths.

    ``docs`` has a row a version, with its ``path`` and ``text``. ``ledger`` has the blobs
    scanned before: blob, version, spans. Only blobs that it lacks under ``version`` are
    scanned; each is scanned once however many paths share it. Returns (one row a version
    with path, blob and spans; the ledger with the new rows).

    Null and empty texts are the empty blob, without findings. Null or repeated paths keep
    their rows. Empty tables give empty results. Other columns are ignored.
    """
    address = docs.select(F.col(path).alias("path"), blob_id(F.col("text")).alias("blob"))
    blobs = docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.filter(F.col("version") == version).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    new = materialise(blobs.select("blob", F.lit(version).alias("version"), scan_text(F.col("text")).alias("spans")))
    known = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    # only blobs with findings take part in the join back to the paths
    found = known.filter((F.col("version") == version) & (F.size("spans") > 0))
    if ledger is not None:  # a ledger may repeat rows
        found = found.dropDuplicates(["blob"])
    out = address.join(found.select("blob", "spans"), "blob", "left")
    return out.select("path", "blob", F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans")), known


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, _ in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones merged, replaced by ``[SECRET]``."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise("")
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.char_length(text) - acc["at"], F.lit(0))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(F.aggregate(spans, begin, step, end))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew where a text
    changed; rows and other columns stay, whatever their names. Each distinct text is scanned
    once. Null, empty and clean texts stay as they are; rows with null or repeated ids are
    treated like others; an empty table gives no rows."""
    found, _ = scan(docs)
    found = found.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    text = F.col("row.text")
    rows = docs.select(whole_rows(docs).alias("row")).withColumn("blob", blob_id(text))
    out = rows.join(found, "blob", "left").withColumn("clean", F.when(F.col("spans").isNotNull(), redact(text, F.col("spans"))).otherwise(text))

    def column(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name == "text":
            return F.col("clean").cast(docs.schema["text"].dataType).alias(name)
        if name == "n_chars":
            counted = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
            return F.when(F.col("spans").isNotNull(), counted).otherwise(old).alias(name)
        return old.alias(name)

    return out.select(*[column(c) for c in docs.columns])


def op7_blob_ledger_secrets(spark, sf_dir):
    """The table as two increments, the second scanned against the ledger that the first left:
    its copies of texts that are known already are not scanned again. Together they are all
    rows."""
    docs = table(spark, sf_dir, "documents")
    early = F.coalesce(F.xxhash64("doc_id") < 0, F.lit(True))
    with scratch() as keep:
        found, ledger = scan(docs.filter(early))
        later, _ = scan(docs.filter(~early), ledger=ledger)
        base = F.filter("spans", lambda s: s["rank"] < len(BASE))
        count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
        out = found.unionByName(later).select(
            F.col("path").alias("doc_id"), *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
            F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        )
        return keep(materialise(out))
