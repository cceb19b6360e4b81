"""Mixing sources to target weights by pivotal dependent rounding.

Native: built-in functions only. Sources by code point (null last) weigh WEIGHTS, repeating; they share
`share` of all words; a target stops at `most` times its source's size and the excess is shared anew by
weight until none is above. A document of a source is wanted target / size times: the whole part is
taken as it is, the fractional part is rounded by duels. In a duel two documents put their fractions
together; with the odds that keep both expectations one of them becomes 0 or 1 and the other carries
the rest on. Duels are held inside small groups of one source and size class, groups being the leaves
of a tree over the hash of doc_id; each group sends one residual up, and every level is a distributed
aggregation over a thirty-second of the rows below, until one residual a source falls to a coin.
Group sizes follow from the row count alone, so no source, however large, makes a large group.

Odds come from hashes of ids and a seed, so reruns agree, whatever the partitions are.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null source is a source, the
last; different texts under one doc_id, or none, are documents of their own. Rows equal in id, source and
text are reckoned together: of m such rows the whole part of m fractions is rounded up, what is left over
duels as one, so they are not all taken alike and a source's target holds however many rows repeat.
Sources of size 0 have target 0. Extra columns are ignored by `plan` and kept by `mix_rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, staged, table

WEIGHTS = (5, 2, 1)
#: Rows of a leaf group, on average, if one source and size class held all rows.
GROUP = 32
#: Rows that one array makes where equal rows are told apart again.
RUN = 100_000


def _size(text: str = "text") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD})"))).cast("long")


def _unit(*parts) -> Column:
    """A number from 0 to 1 by hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size. One row a source: source, source_size, target."""
    spark = sizes.sparkSession
    # rank by code point without one task for all: places in a range-sorted table
    ranked = staged(sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()), "op9_sources")
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before, counts = {}, 0
    for r in ranked.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        before[r["part"]] = counts
        counts += r["count"]
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), part) if before else F.lit(0)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((base + place) % len(weights) + 1).cast("int"))
    known = ranked.select("source", "source_size", w.alias("w"))
    total = float(known.agg(F.sum("source_size")).first()[0] or 0) * share
    # the level of the water: targets are min(most * size, level * weight)
    capped, level = 0, 0.0
    while total:
        full = F.col("w") * level >= F.col("source_size") * most if level else F.lit(False)
        r = known.agg(F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if not r["w"] or (level and r["n"] == capped):
            break
        capped, level = r["n"], (total - r["held"]) / r["w"]
    return known.select("source", "source_size", F.least(F.col("source_size") * F.lit(most), F.col("w") * F.lit(level)).alias("target"))


def _key(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    """What rows of one document have in common, as a string: id, hash of the text, source."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))))


def _duels(items: Column) -> Column:
    """struct(key, source, size, p, out): out has the documents that were rounded, the rest is the residual."""
    null = F.lit(None).cast("string")
    start = F.struct(null.alias("key"), null.alias("source"), F.lit(None).cast("bigint").alias("size"), F.lit(0.0).alias("p"), F.lit(False).alias("on"), F.array().cast("array<struct<key:string,source:string,size:bigint,up:int>>").alias("out"))

    def step(a, b):
        p, q = a["p"], b["p"]
        u = _unit(a["key"], b["key"], F.lit("duel"))
        small = p + q < 1.0
        # the first named stays open, the other is rounded
        a_open = F.when(small, u * (p + q) < p).otherwise(u * (2.0 - p - q) >= 1.0 - q)
        rest = F.when(small, p + q).otherwise(p + q - 1.0)
        up = F.when(small, 0).otherwise(1)
        done = F.struct(*[F.when(a_open, b[n]).otherwise(a[n]).alias(n) for n in ("key", "source", "size")], up.cast("int").alias("up"))
        first = ~a["on"]
        pick = lambda n: F.when(~first & a_open, a[n]).otherwise(b[n]).alias(n)
        return F.struct(pick("key"), pick("source"), pick("size"), F.when(first, q).otherwise(rest).alias("p"), F.lit(True).alias("on"), F.when(first, a["out"]).otherwise(F.concat(a["out"], F.array(done))).alias("out"))

    return F.aggregate(items, start, step)


def pivotal(units: DataFrame, n_rows: int) -> DataFrame:
    """units: key, source, size, p (0 < p < 1, distinct keys). Adds none or one to each: key, source, size, up int."""
    depth = max(0, math.ceil(math.log2(max(1, n_rows) / GROUP)))
    cls = F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int")
    shift_of = lambda bits: F.shiftrightunsigned(F.xxhash64("key", F.lit("leaf")), 64 - bits) if bits else F.lit(0).cast("long")
    levels = [(bits, True) for bits in range(depth, 0, -5)] + [(0, True), (0, False)]
    open_, rounded = units.select("key", "source", "size", "p"), []
    for bits, by_class in levels:
        keys = ["source", "_g"] + (["_c"] if by_class else [])
        item = F.struct("size", "key", "source", "p")
        grouped = open_.withColumns({"_g": shift_of(bits), "_c": cls}).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
        done = staged(grouped.select(_duels(F.col("items")).alias("r")).select("r.key", "r.source", "r.size", "r.p", "r.out"), "op9_level")
        rounded.append(done.select(F.inline("out")).select("key", "source", "size", "up"))
        open_ = done.select("key", "source", "size", "p")
    rounded.append(open_.select("key", "source", "size", (_unit("key", F.lit("coin")) < F.col("p")).cast("int").alias("up")))
    out = rounded[0]
    for r in rounded[1:]:
        out = out.unionByName(r)
    return out


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs: doc_id, source, text. One row a document: key, id, source, size, source_size, target, m (rows that are alike), and what they are taken: each `whole` times, `ups` of them once more."""
    rows = staged(docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), _size().alias("size")).groupBy("key", "id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "op9_rows")
    targets = staged(source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, share, most), "op9_targets")
    n = rows.count()
    renamed = targets.select(F.col("source").alias("_s"), "source_size", "target")
    wanted = rows.join(renamed, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("x", F.when(F.col("size") > 0, F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0))).otherwise(0.0))
    whole = F.floor(F.col("x") + 1e-12)
    parts = F.greatest(F.col("x") - whole, F.lit(0.0)) * F.col("m")
    sure = F.floor(parts + 1e-12)
    wanted = staged(wanted.withColumns({"whole": whole.cast("long"), "sure": sure.cast("long"), "p": F.greatest(parts - sure, F.lit(0.0))}).drop("x"), "op9_wanted")
    ups = pivotal(wanted.select("key", "source", "size", "p").where("p > 1e-12"), n).select(F.col("key").alias("_k"), "up")
    out = wanted.join(ups, F.col("key") == F.col("_k"), "left")
    return out.select("key", "id", "source", "size", "source_size", "target", "m", "whole", (F.col("sure") + F.coalesce(F.col("up"), F.lit(0))).cast("long").alias("ups"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    planned = staged(plan(docs).where("whole + ups > 0").select(F.col("key").alias("__p"), F.col("whole").alias("__w"), F.col("ups").alias("__u")), "op9_plan")
    # one join strategy at every size: both sides by document; equal rows are numbered to tell which go up
    joined = docs.withColumn("__k", _key()).hint("merge").join(planned, F.col("__k") == F.col("__p"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__p"))
    copies = (F.col("__w") + (place <= F.col("__u")).cast("int")).cast("int")
    return joined.withColumn("__c", copies).where("__c > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), "__c"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    runs = mixed.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN))))
    rows = runs.withColumn("_n", F.explode(F.sequence(F.col("_r") * RUN + 1, F.least(F.col("m"), (F.col("_r") + 1) * RUN))))
    taken = (F.col("whole") + (F.col("_n") <= F.col("ups")).cast("int")) * F.col("size")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))
