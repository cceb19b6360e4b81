"""Occurrences of a record, records of one decision, decisions of one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bound, digits, squeeze, summary_key


def occurrences(hits: DataFrame, key: str, formulation: str, position: str, order: str) -> DataFrame:
    """One row a record: the formulations that found it, its best position, and the first task that did."""
    return hits.groupBy(key).agg(F.array_sort(F.collect_set(formulation)).alias("formulations"), F.countDistinct(formulation).alias("n_formulations"), F.min(position).alias("best_position"), F.min(order).alias("first_order"))


def equivalents(rows: DataFrame, *, key: str, court: str, date: str, text: str, number: str, body: str, link: str, position: str, document: Column | None = None) -> DataFrame:
    """One row a decision: copies of one document, or of one court, date and summary, are one.

    Where a group has two numbers or more, each number is a decision and rows without one stay alone.
    A null date or an empty summary never makes rows equal. The most complete copy stands for the
    decision (number, then body, then link, then best position). The text is read in one pass; after it
    rows are slim, and whether a group has two numbers is a window over them.
    """
    alone = F.concat(F.lit("alone:"), F.col(key).cast("string"))

    def named(s: Column) -> Column:
        whole = F.col(date).isNotNull() & (s != "")
        return F.when(whole, F.concat_ws("|", F.col(court), F.col(date), F.sha2(s, 256))).otherwise(alone)

    group = bound(summary_key(F.col(text)), named)
    if document is not None:
        group = F.when(document.isNotNull(), F.concat_ws("|", F.col(court), F.lit("document"), document)).otherwise(group)
    own = bound(digits(F.col(number)), lambda d: F.when(d != "", d))
    slim = rows.select(key, date, position, group.alias("_group"), own.alias("_number"), (F.coalesce(F.col(body), F.lit("")) != "").alias("_b"), (F.coalesce(F.col(link), F.lit("")) != "").alias("_c"))
    by = Window.partitionBy("_group")
    marked = slim.withColumns({"_least": F.min("_number").over(by), "_most": F.max("_number").over(by)})
    one = F.coalesce(F.col("_least") == F.col("_most"), F.lit(True))
    final = F.when(one, F.col("_group")).when(F.col("_number").isNull(), alone).otherwise(F.concat_ws("|", "_group", "_number"))
    rank = F.struct(F.col("_number").isNotNull().alias("a"), F.col("_b"), F.col("_c"), (-F.col(position)).alias("d"), (-F.col(key)).alias("e"))
    grouped = marked.withColumn("_final", final).groupBy("_final")
    return grouped.agg(F.max_by(key, rank).alias("survivor"), F.array_sort(F.collect_list(key)).alias("ids"), F.count(F.lit(1)).alias("n_copies"), F.min(position).alias("best_position"), F.array_sort(F.collect_set(date)).alias("dates")).withColumn("dates_differ", F.size("dates") > 1).drop("_final")


def series(rows: DataFrame, *, key: str, court: str, body: str, rapporteur: str, text: str, order: str) -> DataFrame:
    """One row a series: same court, body, rapporteur and summary but for white space; rows that lack one stay alone."""
    parts = F.array(*[squeeze(F.col(c)) for c in (court, body, rapporteur, text)])
    alone = F.concat(F.lit("alone:"), F.col(key).cast("string"))
    name = bound(parts, lambda p: F.when(F.forall(p, lambda x: F.coalesce(x != "", F.lit(False))), F.sha2(F.array_join(p, "\u0001"), 256)).otherwise(alone))
    slim = rows.select(name.alias("_key"), F.col(key).alias("_id"), F.col(order).alias("_o"))
    place = F.struct(F.col("_o").alias("o"), F.col("_id").alias("k"))
    return slim.groupBy("_key").agg(F.min_by("_id", "_o").alias("first"), F.count(F.lit(1)).alias("n"), F.min("_o").alias("first_order"), F.slice(F.array_sort(F.collect_list(place)), 2, 2_000_000_000)["k"].alias("others")).drop("_key")
