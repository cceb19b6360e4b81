"""Order of a fused list: adherence bands, ties inside a court's own slots, reserved places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.staging import ensure_checkpoints
from ..functions.text import adherence, fold

#: Floors of the adherence bands, from the top; what is below the last is the rest.
BANDS = (1.0, 0.85, 0.7)


def band(value: Column, floors=BANDS) -> Column:
    """0 is the top band, len(floors) the rest."""
    out = F.when(value >= floors[0], 0)
    for n, floor in enumerate(floors[1:], 1):
        out = out.when(value >= floor, n)
    return out.otherwise(len(floors)).cast("int")


def scored(items: DataFrame, formulations: list[str], text: str = "text", floors=BANDS) -> DataFrame:
    """Adds adherence and band; every pattern is a literal, so each is compiled once a task."""
    return items.withColumn("_folded", fold(F.col(text))).withColumn("adherence", adherence(F.col("_folded"), formulations)).drop("_folded").withColumn("band", band(F.col("adherence"), floors))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, the place of each row in the whole order, without one task for all rows.

    Rows are range-sorted and cut by a checkpoint; a row's place is its number in its partition plus
    the sizes of the partitions before (a row a partition goes to the driver).
    """
    ensure_checkpoints(rows.sparkSession)
    sorted_ = rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part, before, seen = F.shiftright("_m", 33), [], 0
    for r in sorted_.groupBy(part.alias("part")).count().orderBy("part").collect():
        before += [F.lit(r["part"]).cast("long"), F.lit(seen).cast("long")]
        seen += r["count"]
    start = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return sorted_.withColumn(name, (start + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_m")


def running(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` up to and with each row in the whole order; the same cut into partitions."""
    ensure_checkpoints(rows.sparkSession)
    sorted_ = rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part, before, seen = F.shiftright("_m", 33), [], 0
    for r in sorted_.groupBy(part.alias("part")).agg(F.sum(value).alias("s")).orderBy("part").collect():
        before += [F.lit(r["part"]).cast("long"), F.lit(seen)]
        seen += r["s"]
    start = F.element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0)
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    return sorted_.withColumn("_part", part).withColumn(name, start + within).drop("_m", "_part")


def ordered(items: DataFrame, court: str, order: str, relevance: str | None = None, block: tuple[str, ...] = ("band", "n_formulations", "best_position"), bounded: bool = True) -> DataFrame:
    """Adds `place`; bounded says that the list is a bounded one (what the tasks of a search may return),
    which one task orders; without it the order is distributed. The order: band up, formulations down, best position up; ties by `order`, a unique number.

    Among rows equal in the three, each court keeps the slots its rows hold and fills them by
    relevance, highest first (null and non-finite last). Slots and fillings are two window ranks over
    (tie block, court), joined on their number.
    """
    key = [F.col(block[0]).asc(), F.col(block[1]).desc(), F.col(block[2]).asc()]
    place = lambda rows, last: rows.withColumn("place", F.row_number().over(Window.orderBy(*key, last))) if bounded else numbered(rows, [*key, last], "place")
    if relevance is None:
        return place(items, F.col(order).asc())
    by = [F.col(c) for c in block]
    note = F.when(F.col(relevance).isNotNull() & ~F.isnan(relevance) & (F.abs(F.col(relevance)) < float("inf")), F.col(relevance))
    slot = F.row_number().over(Window.partitionBy(*by, court).orderBy(F.col(order).asc()))
    want = F.row_number().over(Window.partitionBy(*by, court).orderBy(note.desc_nulls_last(), F.col(order).asc()))
    marked = items.withColumns({"_slot": slot, "_want": want})
    slots = marked.select(*[F.col(c).alias(f"_{c}") for c in block], F.col(court).alias("_court"), "_slot", F.col(order).alias("_at"))
    same = [marked[c].eqNullSafe(slots[f"_{c}"]) for c in block] + [marked[court].eqNullSafe(slots["_court"]), marked["_want"] == slots["_slot"]]
    placed = marked.drop("_slot").join(slots, same).drop(*[f"_{c}" for c in block], "_court", "_slot", "_want")
    return place(placed, F.col("_at").asc()).drop("_at")


def reserved(items: DataFrame, court: str, place: str, most: int, each: int = 3, top: Column | None = None) -> DataFrame:
    """The rows shown: up to `each` of every court from the top band have a place, the rest go by order."""
    top = F.col("band") == 0 if top is None else top
    nth = F.row_number().over(Window.partitionBy(court, top).orderBy(place))
    kept = items.withColumn("_r", top & (nth <= each))
    running = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_r", F.col("_r") & (F.sum(F.col("_r").cast("int")).over(running) <= most))
    everyone = Window.partitionBy()
    free = F.lit(most) - F.sum(F.col("_r").cast("int")).over(everyone)
    rest = F.sum((~F.col("_r")).cast("int")).over(running)
    return kept.withColumn("_show", F.col("_r") | (rest <= free)).where("_show").drop("_r", "_show")


def cut(items: DataFrame, court: str, place: str, most: int, each: int = 3) -> DataFrame:
    """`reserved` at scale: only rows that can be shown are ranked together (the first `most` and each court's first `each` of the top band)."""
    nth = F.row_number().over(Window.partitionBy(court).orderBy(F.col("band") != 0, place))
    able = items.withColumn("_n", nth).where((F.col("_n") <= each) & (F.col("band") == 0)).drop("_n").unionByName(items.orderBy(place).limit(most)).dropDuplicates([place])
    return reserved(able, court, place, most, each)


def by_date(items: DataFrame, date: str, order: str, bounded: bool = True) -> DataFrame:
    """Adds `date_place`: oldest first, what has no YYYY-MM-DD date last, ties as they came."""
    day = F.when(F.substring(date, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(date, 1, 10))
    key = [day.asc_nulls_last(), F.col(order).asc()]
    return items.withColumn("date_place", F.row_number().over(Window.orderBy(*key))) if bounded else numbered(items, key, "date_place")
