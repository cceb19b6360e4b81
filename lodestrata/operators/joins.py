"""Join shapes of the retrieval rules: tolerance, ranges, anti joins, side by side, paradigms, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.staging import ensure_checkpoints
from ..functions.text import digits, fold, formless


def _micros(time: str):
    return F.unix_micros(F.col(time).cast("timestamp"))


def within(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int, on: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs whose times differ by `seconds` at most: an equi join on time buckets, then the exact condition."""
    width = max(1, seconds)
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(_micros(left_time) / (width * 1_000_000)) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_rb", F.floor(_micros(right_time) / (width * 1_000_000)))
    same = (F.col("_b") == F.col("_rb")) & (F.abs(_micros(left_time) - _micros(right_time)) <= seconds * 1_000_000)
    for x, y in on:
        same = same & (F.col(x) == F.col(y))
    return a.join(b, same).drop("_b", "_rb")


def in_ranges(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, bucket: int = 64) -> DataFrame:
    """Points with the ranges they lie in: ranges are dealt to buckets, so the join is an equi join."""
    dealt = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    return points.withColumn("_pb", F.floor(F.col(point) / bucket)).join(dealt, (F.col("_pb") == F.col("_b")) & F.col(point).between(F.col(low), F.col(high))).drop("_pb", "_b")


# Kinds of appeal against a decision, by the start of the class and by the first word of the number.
APPEAL_CLASSES = ("embargos de declaracao", "agravo interno", "agravo regimental", "embargos infringentes", "embargos de divergencia")
APPEAL_SIGNS = ("ed", "edcl", "agint", "agrg", "ei", "eresp", "earesp", "ere", "eag")


def is_appeal(class_: str, number: str):
    """By the class where there is one, else by the number's first word."""
    folded = F.trim(fold(F.col(class_)))
    by_class = folded.rlike("^(?:" + "|".join(APPEAL_CLASSES) + ")")
    by_sign = F.trim(fold(F.element_at(F.split(F.col(number), r"\s+"), 1))).isin(list(APPEAL_SIGNS))
    return F.when(F.coalesce(F.col(class_), F.lit("")) != "", by_class).otherwise(F.coalesce(by_sign, F.lit(False)))


def appeals_alone(shown: DataFrame, found: DataFrame, *, court: str, cnj: str, class_: str, number: str, order: str) -> DataFrame:
    """Shown appeals whose decision was not found; one a court and number, the first."""
    key = digits(F.col(cnj))
    decided = found.where(F.col(cnj).isNotNull() & ~is_appeal(class_, number)).select(key.alias("_k")).distinct()
    open_ = shown.where(F.col(cnj).isNotNull() & is_appeal(class_, number)).withColumn("_d", key).join(decided, F.col("_d") == F.col("_k"), "left_anti")
    first = F.row_number().over(Window.partitionBy(court, "_d").orderBy(order))
    return open_.withColumn("_n", first).where("_n = 1").drop("_n", "_d")


def verify_cited(cited: DataFrame, records: DataFrame) -> DataFrame:
    """cited: cite, number, date, body. records: id, number, cnj, has_number, date, body.

    The best record of the number (fewest conflicts, then fewest unchecked) with state confirmed,
    conflict or unverified; not found is unverified, never said not to exist.
    """
    r = records.where("has_number")
    keys = F.array_distinct(F.array_compact(F.array(digits(F.col("number")), digits(F.col("cnj")))))
    flat = r.withColumn("_k", F.explode(F.filter(keys, lambda k: k != ""))).select("_k", "id", F.col("date").alias("r_date"), F.col("body").alias("r_body"))
    c = cited.withColumn("_c", digits(F.col("number")))
    both = c.join(flat, (F.col("_c") == F.col("_k")) & (F.col("_c") != ""), "left")
    day, body = F.col("date").isNotNull(), F.col("body").isNotNull()
    r_body = formless(F.coalesce("r_body", F.lit("")))
    conflicts = (day & F.col("r_date").isNotNull() & (F.substring("r_date", 1, 10) != F.col("date"))).cast("int") + (body & (r_body != "") & (r_body != formless(F.col("body")))).cast("int")
    unchecked = (day & F.col("r_date").isNull()).cast("int") + (body & (r_body == "")).cast("int")
    scored = both.withColumns({"conflicts": F.coalesce(conflicts, F.lit(0)), "unchecked": F.coalesce(unchecked, F.lit(0))})
    best = F.row_number().over(Window.partitionBy("cite").orderBy("conflicts", "unchecked", F.col("id").asc_nulls_last()))
    others = F.count("id").over(Window.partitionBy("cite")) - F.lit(1)
    state = F.when(F.col("id").isNull(), "unverified").when(F.col("conflicts") > 0, "conflict").otherwise("confirmed")
    return scored.withColumns({"_n": best, "others": F.greatest(others, F.lit(0))}).where("_n = 1").select("cite", "id", state.alias("state"), "conflicts", F.when(F.col("id").isNotNull(), F.col("unchecked")).otherwise(0).alias("unchecked"), "others")


def side_by_side(a: DataFrame, b: DataFrame, key: str, failed_a: bool = False, failed_b: bool = False) -> DataFrame:
    """Full outer by key, each side found, not found or failed: failing is never not finding."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("n_b"))
    both = x.join(y, key, "full_outer")
    said = lambda n, failed: F.lit("failed") if failed else F.when(F.col(n).isNull(), "not_found").otherwise("found")
    return both.select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), said("n_a", failed_a).alias("state_a"), said("n_b", failed_b).alias("state_b"))


def overlay(site: DataFrame, ranked: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records of two answers by key: what the second says goes over the first."""
    a = site.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    return a.join(ranked, F.col("_k") == F.col(key), "full_outer").select(F.coalesce(key, "_k").alias(key), *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def identities(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Copies of one thing under several names: a, b (long) give node and its least name.

    Labels go over the edges until none changes; every round is cut by a checkpoint.
    """
    ensure_checkpoints(edges.sparkSession)
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct().checkpoint()
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")).checkpoint()
    for _ in range(rounds):
        sent = both.join(labels, both.src == labels.node).groupBy("dst").agg(F.min("label").alias("m"))
        near = labels.join(sent, labels.node == sent.dst).select("node", "label", F.least("label", "m").alias("new"))
        up = near.select(F.col("node").alias("_n"), F.col("new").alias("_l"))
        after = near.join(up, F.col("new") == F.col("_n"), "left").select("node", F.coalesce("_l", "new").alias("new"), "label").checkpoint()
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("labels still change")


def pack(rows: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """Rows of a group, in order, into parts of `most` at most: a row opens a part when it doesn't fit the open one."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("items"))
    zero = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,part:int>>").alias("out"))

    def step(acc, x):
        fits = (acc["used"] + x["s"] <= most) & (acc["part"] > 0)
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(part.alias("part"), F.when(fits, acc["used"] + x["s"]).otherwise(x["s"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["o"].cast("long").alias("o"), part.alias("part")))).alias("out"))

    return listed.select(by, F.inline(F.aggregate("items", zero, step)["out"])).withColumnRenamed("o", order)


def last_title(rows: DataFrame, by: str, order: str, title) -> DataFrame:
    """Adds `section`: the last title at or before each row."""
    return rows.withColumn("section", F.last(title, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
