"""Counts over a sample: who decided what, when, with a bounded list of names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NO_DATE, NO_BODY = "(sem data)", "(sem órgão)"


def counts(rows: DataFrame, *, key: str, court: str, date: str, body: str, rapporteur: str) -> DataFrame:
    """One row a count: list (court, year, body, rapporteur, no_rapporteur), court, name, n; a key counts once.

    The four lists come from one pass (grouping sets over one expanded row set).
    """
    one = rows.dropDuplicates([key])
    named = F.coalesce(F.trim(rapporteur), F.lit("")) != ""
    year = F.coalesce(F.when(F.col(date) != "", F.substring(date, 1, 4)), F.lit(NO_DATE))
    lists = F.array(
        F.struct(F.lit("court").alias("list"), F.lit(None).cast("string").alias("c"), F.col(court).alias("name")),
        F.struct(F.lit("year").alias("list"), F.lit(None).cast("string").alias("c"), year.alias("name")),
        F.struct(F.lit("body").alias("list"), F.col(court).alias("c"), F.coalesce(F.when(F.col(body) != "", F.col(body)), F.lit(NO_BODY)).alias("name")),
        F.struct(F.when(named, "rapporteur").otherwise("no_rapporteur").alias("list"), F.col(court).alias("c"), F.when(named, F.col(rapporteur)).otherwise(F.lit("")).alias("name")),
    )
    return one.select(F.inline(lists)).groupBy("list", F.col("c").alias("court"), "name").agg(F.count(F.lit(1)).alias("n"))


def top_names(counted: DataFrame, most: int = 20, longest: int = 200) -> DataFrame:
    """Each list's most frequent names (by count, then name) and the rest as one sum; names over `longest` are only summed."""
    long = F.length("name") > longest
    place = F.row_number().over(Window.partitionBy("list", "court", long).orderBy(F.col("n").desc(), "name"))
    shown = counted.withColumn("_p", place).withColumn("shown", ~long & (F.col("_p") <= most))
    return shown.groupBy("list", "court", F.when(F.col("shown"), F.col("name")).alias("name")).agg(F.sum("n").alias("n"))


def share_budget(lists: list[list[tuple[str, int]]], most: int, budget: int, longest: int = 200) -> tuple[list[list[tuple[str, int]]], list[int]]:
    """A budget of characters dealt over lists, a row of each in turn; what is not shown is summed.

    The rows of all lists make one order, by place in their list and then by list; a running sum of costs
    goes along it, and a list ends at its first row that no longer fits. Each step hangs on those before,
    so this runs on the bounded lists that `top_names` leaves.
    """
    offers = []
    for number, rows in enumerate(lists):
        ranked = sorted((r for r in rows if len(r[0]) <= longest), key=lambda r: (-r[1], r[0]))
        offers += [(place, number, name, n) for place, (name, n) in enumerate(ranked[:most])]
    spent, ended, shown = 0, set(), [[] for _ in lists]
    for _, number, name, n in sorted(offers):
        cost = len(json.dumps([name, n], ensure_ascii=False)) - 2
        if number in ended or spent + cost > budget:
            ended.add(number)
        else:
            spent += cost
            shown[number].append((name, n))
    return shown, [sum(n for _, n in rows) - sum(n for _, n in own) for rows, own in zip(lists, shown, strict=True)]


def missing_months(rows: DataFrame, date: str, by: str) -> DataFrame:
    """Months between a group's first and last that have no row: by, month."""
    month = F.date_trunc("month", F.col(date)).cast("date")
    have = rows.where(F.col(date).isNotNull()).select(by, month.alias("month")).distinct()
    spans = have.groupBy(by).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return spans.select(by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).join(have, [by, "month"], "left_anti")


# Fixed value: the one form in which a rapporteur carries the writer of the decision.
WRITES = r"^[^()\s](?:[^()]*[^()\s])? \(relator para o acórdão: [^()\s](?:[^()]*[^()\s])?\)$"


def writes_decision(name):
    """Whether a name carries the one who writes the decision."""
    return name.rlike(WRITES)


def name_caveat(counted: DataFrame, n: str, few: int = 3) -> DataFrame:
    """Adds `caveat`: a name filter left so few rows that another spelling may be the reason."""
    return counted.withColumn("caveat", F.col(n) <= few)
