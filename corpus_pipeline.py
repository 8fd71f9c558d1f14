"""Corpus pipeline: five stages over ``documents``, each calling one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import mixing, neardup, pieces, quality, secrets
from tracewell.llm.common import materialise, release, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from ``labels`` and the texts of
    ``docs``; equal texts share their fate, null and empty ones too; without labels all stay.
    Columns, whatever their names, and repeated rows stay; an empty table gives none."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id; of
    rows with one doc_id, one. Texts without words and rows with null ids are in no group and
    stay. Columns, whatever their names, stay; an empty table gives none."""
    return neardup.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars counted anew there. Null, empty and clean
    texts, other columns, whatever their names, and all rows stay; an empty table gives none."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken to its target weight; a document taken twice is there twice, one not
    taken goes. Null sources are one source; null texts have no words and cost nothing; ties
    go by a hash, so reruns agree. Columns, whatever their names, stay; an empty table gives none."""
    return mixing.mix_documents(docs)


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text of each row; a null text is
    encoded as the empty one. Other columns are ignored; an empty table gives none."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece_encode),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py holds each stage
#: against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as keep:
            out = keep(materialise(stage(spark, docs, sf_dir)))
        release(docs)
        docs = out
    return docs
