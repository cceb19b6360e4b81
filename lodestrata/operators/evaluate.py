"""Retrieval quality and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered, running


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where the whole is 0."""
    return F.when(whole != 0, part / whole)


def precision(shown: DataFrame, dims: list[str], relevant: str, key: str) -> DataFrame:
    """Per dimension and over all (rollup): shown, relevant, precision, distinct keys found."""
    out = shown.rollup(*dims).agg(F.count(F.lit(1)).alias("n_shown"), F.count_if(F.col(relevant)).alias("n_relevant"), F.countDistinct(F.when(F.col(relevant), F.col(key))).alias("n_found"))
    return out.withColumn("precision", share(F.col("n_relevant"), F.col("n_shown")))


def majority(a: Column, b: Column, c: Column) -> Column:
    """Two votes that agree, else the third if it agrees with one, else none."""
    return F.when(a == b, a).when(c.isNotNull() & ((c == a) | (c == b)), c)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two binary columns; null if chance alone agrees always."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    m = rows.agg(F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"), F.count(F.lit(1)).alias("n"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select("n", "po", F.when(pe != 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def confusion(rows: DataFrame, by: list[str], warned: str, true: str) -> DataFrame:
    """Per group: the four counts, precision, recall and the share of false alarms."""
    w, t = F.col(warned), F.col(true)
    c = rows.groupBy(*by).agg(F.count_if(w & t).alias("tp"), F.count_if(w & ~t).alias("fp"), F.count_if(~w & t).alias("fn"), F.count_if(~w & ~t).alias("tn"))
    return c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "false_alarm": share(F.col("fp"), F.col("fp") + F.col("tn"))})


def quantiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, and 95th percentile by nearest rank: rows are placed in one distributed order by (group, value), and
    only the rows at the places that each group needs are looked up, so no task holds a group."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*by, value), [*[F.col(c).asc() for c in by], F.col(value).asc()], "_p")
    groups = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_p").alias("_s"))
    at = lambda rank, name: F.struct((F.col("_s") + rank - 1).cast("long").alias("_w"), F.lit(name).alias("_what"))
    wanted = groups.select(*by, "n", F.inline(F.array(at(F.floor((F.col("n") + 1) / 2), "low"), at(F.floor(F.col("n") / 2) + 1, "high"), at(F.ceil(F.col("n") * F.lit(95) / F.lit(100)), "p95"))))
    found = wanted.join(placed.select("_p", F.col(value).alias("_v")), F.col("_w") == F.col("_p"))
    pick = lambda name: F.max(F.when(F.col("_what") == name, F.col("_v")))
    return found.groupBy(*by).agg(F.max("n").alias("n"), ((pick("low") + pick("high")) / 2).alias("median"), pick("p95").alias("p95"))


def mann_whitney(rows: DataFrame, side: str, value: str) -> DataFrame:
    """z of two samples (side is true or false), ties at their average rank. Ties are grouped first, so ranks run over values."""
    v = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    t = F.col("a") + F.col("b")
    summed = running(v.withColumn("_t", t), [F.col(value).asc()], "_t", "_upto")
    ranked = summed.select("a", "b", F.col("_t").alias("t"), (F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / 2).alias("rank"))
    s = ranked.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("rank")).alias("ra"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"))
    n = (F.col("na") + F.col("nb")).cast("double")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    variance = F.col("na") * F.col("nb") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return s.select("na", "nb", u.alias("u"), ((u - F.col("na") * F.col("nb") / 2) / F.sqrt(variance)).alias("z"))


def verdict(z: float, before: float, after: float) -> str:
    """worse, better or equal: only a sure, large enough difference counts."""
    change = after - before
    if abs(z) < 2.58 or abs(change) < 0.05 * before or abs(change) < 2:
        return "equal"
    return "worse" if change > 0 else "better"


def gauge(measured: DataFrame, floors: DataFrame, by: str, value: str, slack: float = 0.05) -> DataFrame:
    """Groups whose value is under its floor by more than the slack."""
    return measured.join(floors, by).where(F.col(value) < F.col("floor") - slack)


def first_place(known: DataFrame, ranked: DataFrame, on: list[str], place: str) -> DataFrame:
    """Known items with their first place in a list; null where it isn't there."""
    best = ranked.groupBy(*on).agg(F.min(place).alias("first_place"))
    return known.join(best, on, "left")


def drawn(key: str, seed: int) -> Column:
    """A lot for each key: 32 bits of a hash that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def blind_pool(pool: DataFrame, others: DataFrame, key: str, seed: int, tenth: int = 10) -> DataFrame:
    """The pool with about one control in ten from outside it, in an order that a hash gives."""
    controls = others.join(pool.select(key), key, "left_anti").where(drawn(key, seed) % tenth == 0)
    both = pool.select(key, F.lit(False).alias("control")).unionByName(controls.select(key, F.lit(True).alias("control")))
    return both.withColumn("shuffle", drawn(key, seed + 1))
