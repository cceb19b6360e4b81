"""Stored answers with a time to live, and JSON at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def put(answers: DataFrame, path: str, key: Column, at: Column) -> None:
    """Append answers under the hash of their request; files of a day lie together, so old days can be dropped whole."""
    stored = answers.select(F.sha2(key, 256).alias("key"), at.alias("at"), F.to_json(F.struct(*answers.columns)).alias("payload"), F.lit(FORMAT).alias("format"), F.to_date(at).alias("day"))
    stored.write.mode("append").partitionBy("day").parquet(path)


def get(spark: SparkSession, path: str, now: Column, hours: int = 24) -> DataFrame:
    """The newest live answer of each key; entries of another format are passed over, never deleted. Old days are pruned at the scan."""
    rows = spark.read.parquet(path)
    since = now - F.expr(f"interval {hours} hours")
    live = rows.where((F.col("format") == FORMAT) & (F.col("day") >= F.to_date(since)) & (F.col("at") > since) & (F.col("at") <= now))
    return live.groupBy("key").agg(F.max_by(F.struct("at", "payload"), F.struct("at", "payload")).alias("v")).select("key", "v.at", "v.payload")


def response(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as compact JSON; absent fields are left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def index_state(files: DataFrame, receipts: DataFrame, indexes: DataFrame, key: str) -> DataFrame:
    """Whether each file's index may stand for it: `reason` is null, or why a search reads the whole file.

    files: key, bytes, modified, sha256 (null where it was not read again); receipts: key, sha256; indexes: key, bytes,
    modified, sha256 of the file the index was built from. Equal size and date prove nothing where the hash differs.
    """
    r = receipts.select(F.col(key), F.col("sha256").alias("_said"), F.lit(True).alias("_receipt"))
    i = indexes.select(F.col(key), F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified"), F.col("sha256").alias("_built"), F.lit(True).alias("_index"))
    both = files.join(i, key, "left").join(r, key, "left")
    moved = ~(F.col("_built").eqNullSafe(F.col("_said")) & F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("modified").eqNullSafe(F.col("_modified")))
    reason = F.when(F.col("_index").isNull(), "no_index").when(F.col("_said").isNull(), "no_receipt").when(moved, "file_changed").when(~F.col("sha256").eqNullSafe(F.col("_built")), "content_changed")
    return both.select(key, reason.alias("reason"))
