"""Unions, versions and orders of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.passages import STATES
from .ranking import numbered


def latest_versions(rows: DataFrame, key: str, identity: list[str], order: str) -> DataFrame:
    """Records that no later one replaces: a record goes when a later one has its key, or its whole identity.

    Both are last-of-group windows; a record whose identity lacks a part is replaced by key only.
    """
    last_key = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())) == 1
    whole = F.lit(True)
    for c in identity:
        whole = whole & F.col(c).isNotNull()
    marked = rows.withColumns({"_last": last_key, "_whole": whole})
    last_identity = F.row_number().over(Window.partitionBy(*identity, F.when(~F.col("_whole"), F.col(order))).orderBy(F.col(order).desc())) == 1
    return marked.withColumn("_last2", last_identity).where(F.col("_last") & F.col("_last2")).select(rows.columns)


def pool(lists: list[DataFrame], key: str, value: str) -> DataFrame:
    """One row a key over several lists: the longest value, and how many lists have it."""
    both = lists[0].select(key, value, F.lit(0).alias("_n"))
    for n, df in enumerate(lists[1:], 1):
        both = both.unionByName(df.select(key, value, F.lit(n).alias("_n")))
    longest = F.max_by(value, F.struct(F.length(value), -F.col("_n"), value))
    return both.groupBy(key).agg(longest.alias(value), F.countDistinct("_n").alias("n_lists"))


def only_and_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key as only_a, only_b or both."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both").alias("side"))


def interleaved(rows: DataFrame, list_: str, order: str) -> DataFrame:
    """Lists dealt in rounds: `round` and, inside it, lists in order; no task ranks all rows."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(list_).orderBy(order)))


def capped(tasks: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` tasks run, the rest are capped."""
    first = tasks.orderBy(*order).limit(most).withColumn("state", F.lit("run"))
    return tasks.join(F.broadcast(first.select(*order, "state")), order, "left").fillna("capped", ["state"])


def movement_order(rows: DataFrame, instant: str, raw: str, by: str) -> DataFrame:
    """Adds `place`: by instant, what has none after, by its text."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col(instant).isNull(), instant, raw)))


def strict_match(pages: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Inner join where every page must be listed."""
    if pages.join(listed, key, "left_anti").limit(1).count():
        raise ValueError("a page is not in the list")
    return pages.join(listed, key)


def expand_courts(wanted: list[str], group: str = "trt", members: tuple[str, ...] = tuple(f"trt{n}" for n in range(1, 25))) -> list[str]:
    """A group name stands for its members, those asked for by name staying where they are; none twice."""
    if group not in [w.lower() for w in wanted]:
        return list(wanted)
    named, seen, out = {w.lower() for w in wanted}, set(), []
    for w in wanted:
        for x in [m for m in members if m not in named] if w.lower() == group else [w]:
            if x.lower() not in seen or x.lower() not in members:
                seen.add(x.lower())
                out.append(x)
    return out


def registry(spark: SparkSession) -> DataFrame:
    """court, kind, segment: built by rule."""
    rows = [("stf", "highest", "1.00"), ("stj", "highest", "3.00")] + [("tjdft" if s == "df" else f"tj{s}", "state", f"8.{n:02d}") for n, s in enumerate(STATES, 1)]
    rows += [(f"trt{n}", "labour", f"5.{n:02d}") for n in range(1, 25)] + [(f"trf{n}", "federal", f"4.{n:02d}") for n in range(1, 7)]
    return spark.createDataFrame(rows, "court string, kind string, segment string")


def safe_rules(votes: DataFrame, rule: str, fold: str, relevant: str) -> DataFrame:
    """votes: a row for each item that a rule excludes. The rule of each fold that loses no relevant item and removes most there, with what it does in the other."""
    c = votes.groupBy(rule, fold).agg(F.count(F.lit(1)).alias("removed"), F.count_if(F.col(relevant)).alias("lost"))
    best = F.row_number().over(Window.partitionBy(fold).orderBy(F.col("removed").desc(), rule))
    chosen = c.where("lost = 0").withColumn("_n", best).where("_n = 1").select(F.col(fold).alias("fitted_on"), F.col(rule).alias("chosen"), F.col("removed").alias("removed_there"))
    other = c.select(F.col(rule).alias("chosen"), F.col(fold).alias("tried_on"), "removed", "lost")
    return chosen.join(other, "chosen", "left").where("tried_on <> fitted_on or tried_on is null")


def copies_merged(rows: DataFrame, key: str, ids: str, formulations: str, position: str, date: str) -> DataFrame:
    """One row a record over its copies: the union of what found them, the best place, and the dates where they differ.

    Sets are reduced before the shuffle; they hold formulations and dates of one record, which are few.
    """
    one = rows.groupBy(key).agg(F.count_distinct(ids).alias("n_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(formulations)))).alias("formulations"), F.min(position).alias("best_position"), F.array_sort(F.collect_set(date)).alias("_dates"))
    return one.select(key, "n_ids", "formulations", "best_position", F.when(F.size("_dates") > 1, F.col("_dates")).alias("dates_differ"))


def theme_processes(themes: DataFrame, processes: DataFrame, key: str, process: str, leads: str, withdrawn: str, order: str) -> DataFrame:
    """Themes with the processes that lead them, in the order of their first rows; none that was withdrawn. Themes without one stay."""
    good = processes.where((F.col(leads) == "S") & (F.coalesce(F.trim(F.col(withdrawn)), F.lit("")) == "") & (F.trim(F.col(process)) != ""))
    first = good.groupBy(key, F.trim(F.col(process)).alias("_p")).agg(F.min(order).alias("_at"))
    listed = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_p"))), lambda x: x["_p"]).alias("processes"))
    return themes.join(listed, key, "left")


def index_order(rows: DataFrame, date: str, register: str, key: str) -> DataFrame:
    """Adds `place`: by date, register, key, what is missing first; by code point, in one distributed order."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).asc()
    return numbered(rows, [blank(date), blank(register), F.col(key).asc()], "place")


def court_lists(rows: DataFrame, key: str, courts: str, group: str = "trt", members: tuple[str, ...] = tuple(f"trt{n}" for n in range(1, 25))) -> DataFrame:
    """`expand_courts` over rows: key, place, court. A group stands for the members not asked for by name; none twice."""
    name = lambda c: F.lower(c)
    asked = rows.select(key, F.col(courts).alias("_all"), F.posexplode(courts).alias("_n", "_c"))
    rest = F.array_except(F.array(*map(F.lit, members)), F.transform("_all", name))
    spread = asked.select(key, "_n", F.posexplode(F.when(name(F.col("_c")) == group, rest).otherwise(F.array("_c"))).alias("_m", "court"))
    once = spread.groupBy(key, F.lower("court").alias("_l")).agg(F.min(F.struct("_n", "_m", "court")).alias("f"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("f._n", "f._m"))
    return once.select(key, place.alias("place"), F.col("f.court").alias("court"))
