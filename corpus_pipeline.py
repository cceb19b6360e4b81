"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of documents; the last adds `ids` and `n_ids`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import mixing, near_dedup, quality_classifier, secret_scans, sentencepiece_codec
from lodestrata.llm.common import small_batches, staged, table

#: The first stage learns from a table that the driver gives, and others draw lots by hash, so no SQL twin.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    small_batches(spark)
    return quality_classifier.keep_target(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secret_scans.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources come near their targets."""
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become SentencePiece ids."""
    small_batches(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [("quality classifier", quality), ("near dedup", near_duplicates), ("secret scans", secrets), ("mixing", mix), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = staged(docs, f"pipeline_{n}")
    return docs
