"""From documents to packed training sequences: quality, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.

Stages decide by row, which is doc_id and text together, so null keys, keys with several texts and repeated rows need no
special care: rows with both equal share every decision. Null and empty texts, texts and words of any length, empty
tables (they give empty ones) and further columns of any name are allowed in every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import exact_dedup, minhash, packing, pii, quality
from rasterloom.llm.common import fresh, identity, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labels of these documents.

    Null and empty texts are scored as texts of no words; equal rows stay or go together."""
    docs, row = _with_row(docs)
    scores = quality.score_quality(docs, table(spark, sf_dir, "labels"), keep=(row,))
    return _only(docs, scores.filter("predicted = 1"), row).drop(row)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, of those the smallest doc_id, null first.

    Null texts equal empty ones; of repeated rows one stays."""
    docs, row = _with_row(docs)
    keyed = docs.select(F.struct(F.col("doc_id"), F.col(row).alias("row")).alias("key"), "text")
    kept = exact_dedup.exact_dedup(keyed, key="key").filter("kept").select(F.col("key.row").alias(row))
    return _only(docs, kept, row).dropDuplicates([row]).drop(row)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at similarity 0.8 reach stays: that of the smallest
    doc_id, one without a doc_id only where no other is in the group.

    Documents without words are linked with nothing and stay; of repeated rows one stays."""
    kept = minhash.near_rows(docs, shingle=5, percent=80).filter("kept")
    docs, row = _with_row(docs)
    return _only(docs, kept.select(F.col("row").alias(row)), row).dropDuplicates([row]).drop(row)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text. All rows stay, null texts as they are."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens. Every row is packed; null and empty texts are one end id."""
    return packing.pack(docs)


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the identity of each row, and the name of its column."""
    row = fresh(docs, "row_identity")
    return docs.withColumn(row, identity(F.col("doc_id"), F.col("text"))), row


def _only(docs: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """The rows of docs that are in kept."""
    return docs.join(kept.select(row), row, "left_semi").select(*docs.columns)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: The classifier, the linking and the tokens have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None
