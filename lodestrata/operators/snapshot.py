"""Two versions of a keyed table: what changed, and whether the change is believable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A change of that many rows and that share of the old ones is refused.
LEAST_CHANGED, CHANGED_SHARE = 20, 0.25


class SuspiciousChange(RuntimeError):
    """A candidate that loses rows or changes too many."""


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with `change`: removed, added, changed or same; null-safe over all other columns."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*values).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_in_new"))
    same = reduce(lambda x, y: x & y, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys))
    change = F.when(F.col("_in_new").isNull(), "removed").when(F.col("_in_old").isNull(), "added").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, same, "full_outer").select(*[F.when(F.col("_in_new").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys], change.alias("change"))


def guard(changes: DataFrame, least: int = LEAST_CHANGED, share: float = CHANGED_SHARE) -> DataFrame:
    """One row: the counts, and `refused` (lost_rows, large_change) or null."""
    n = changes.agg(F.count_if(F.col("change") != "added").alias("n_old"), *[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("removed", "added", "changed")])
    large = (F.col("n_old") > 0) & (F.col("n_changed") >= least) & (F.col("n_changed") >= share * F.col("n_old"))
    return n.withColumn("refused", F.when(F.col("n_removed") > 0, "lost_rows").when(large, "large_change"))


def publish(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Write the new version unless the guard refuses it; gives the guard's row."""
    verdict = guard(compare(old, new, keys))
    refused = verdict.first()["refused"]
    if refused:
        raise SuspiciousChange(refused)
    new.write.mode("errorifexists").parquet(path)
    return verdict


def merge_repeated(rows: DataFrame, keys: list[str], collect: str) -> DataFrame:
    """Rows equal but for `collect` become one with all its values; `conflict` says where others differ."""
    rest = [c for c in rows.columns if c not in (*keys, collect)]
    whole = F.struct(*rest)
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(collect)).alias(collect), F.count_distinct(F.xxhash64(whole)).alias("_n"), *[F.min(c).alias(c) for c in rest])
    return out.withColumn("conflict", F.col("_n") > 1).drop("_n")
