"""Federated retrieval and fusion: formulations by courts, one list, and a report of what was searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold, stems, truncated
from .dedup import occurrences
from .ranking import cut, ordered, running, scored


#: Sizes of a snippet, tried from the largest.
SNIPPETS = (110, 80, 60, 40)


class NothingAnswered(RuntimeError):
    """No task answered: a failure, never an empty list."""


def tasks(spark, formulations: list[str], courts: list[str]) -> DataFrame:
    """The cross product, numbered court by court: formulation, court, task."""
    rows = [(f, c, n * len(formulations) + f) for n, c in enumerate(courts) for f in range(len(formulations))]
    return spark.createDataFrame(rows, "formulation int, court string, task int")


def retrieve(docs: DataFrame, formulations: list[str], courts: list[str], *, key: str, court: str, text: str, most: int) -> DataFrame:
    """What each task finds: its `most` best rows, by stems matched, then key. One scan for all tasks."""
    folded = docs.where(F.col(court).isin(courts)).withColumn("_folded", fold(F.col(text)))
    counts = [F.struct(F.lit(n).alias("formulation"), sum((s.within(F.col("_folded")).cast("int") for s in stems(f)), F.lit(0)).alias("matched")) for n, f in enumerate(formulations)]
    hits = folded.select(F.col(key), F.col(court).alias("court"), F.inline(F.array(*counts))).where("matched > 0")
    place = F.row_number().over(Window.partitionBy("formulation", "court").orderBy(F.col("matched").desc(), F.col(key).asc()))
    order = F.element_at(F.create_map(*[x for n, c in enumerate(courts) for x in (F.lit(c), F.lit(n))]), F.col("court")) * len(formulations) + F.col("formulation")
    # the bound stands on the number itself, so each task keeps its best rows before the shuffle
    best = hits.withColumn("_place", place).where(F.col("_place") <= most).withColumn("position", F.col("_place") - 1).drop("_place")
    return best.withColumn("task_order", (order * most + F.col("position")).cast("long"))


def fuse(docs: DataFrame, formulations: list[str], courts: list[str], *, key="doc_id", court="lang", text="text", most=50, per_task=50, each=3) -> DataFrame:
    """The shown list: union, one row a record, adherence bands, order, reserved places; `place` is the order of all."""
    found = occurrences(retrieve(docs, formulations, courts, key=key, court=court, text=text, most=per_task), key, "formulation", "position", "task_order")
    rows = scored(docs.select(key, F.col(court).alias("court"), F.col(text).alias("text")).join(found, key), formulations).drop("text")
    placed = ordered(rows, "court", "first_order")
    return cut(placed, "court", "place", most, each)


def coverage(all_tasks: DataFrame, outcomes: DataFrame, hits: DataFrame, shown: DataFrame) -> DataFrame:
    """One row a court: how many tasks are done, empty, failed or not run, why, and what was found and shown.

    outcomes: formulation, court, status (answered, error, capped), reason. A task without an outcome was not run.
    """
    found = hits.groupBy("court", "formulation").agg(F.count(F.lit(1)).alias("n"))
    state = all_tasks.join(outcomes, ["formulation", "court"], "left").join(found, ["court", "formulation"], "left")
    answered = F.col("status") == "answered"
    per_court = state.groupBy("court").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(answered).alias("n_answered"),
        F.count_if(answered & F.col("n").isNull()).alias("n_empty"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.count_if(F.col("status") == "capped").alias("n_capped"),
        F.count_if(F.col("status").isNull()).alias("n_not_run"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )
    distinct = hits.groupBy("court").agg(F.countDistinct("doc_id").alias("n_found"))
    seen = shown.groupBy("court").agg(F.count(F.lit(1)).alias("n_shown"))
    return per_court.join(distinct, "court", "left").join(seen, "court", "left").fillna(0, ["n_found", "n_shown"])


def reason_counts(rows: DataFrame, key: Column, reason: str) -> DataFrame:
    """key, counts: a map of how often each reason came, reasons in order; counted before the shuffle by key."""
    n = rows.groupBy(key, reason).agg(F.count(F.lit(1)).alias("_n"))
    name = n.columns[0]
    return n.groupBy(name).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "_n")))).alias("counts"))


def require_answer(outcomes: DataFrame) -> DataFrame:
    """The outcomes, unless none is an answer."""
    if not outcomes.where("status = 'answered'").limit(1).count():
        raise NothingAnswered("no task answered")
    return outcomes


def barren(all_tasks: DataFrame, outcomes: DataFrame, hits: DataFrame) -> DataFrame:
    """Formulations that every court answered and that found nothing."""
    state = all_tasks.join(outcomes.select("formulation", "court", "status"), ["formulation", "court"], "left")
    silent = state.groupBy("formulation").agg(F.count_if(F.col("status") == "answered").alias("a"), F.count(F.lit(1)).alias("n")).where("a = n")
    return silent.select("formulation").join(hits.select("formulation").distinct(), "formulation", "left_anti")


def qualified(found: DataFrame, most: int = 10, chars: int = 300) -> DataFrame:
    """Precedents of all searches without repeats (court, kind, number or text), by how many formulations brought them."""
    name = F.concat_ws("|", "court", "kind", F.coalesce("number", "text"))
    one = found.withColumn("_k", name).groupBy("_k").agg(F.min_by(F.struct("court", "kind", "number", "text"), "ord").alias("q"), F.countDistinct("formulation").alias("n_formulations"), F.min("ord").alias("first_ord"))
    cut_text = F.when(F.length("q.text") > chars, F.concat(F.substring("q.text", 1, chars), F.lit("…"))).otherwise(F.col("q.text"))
    return one.orderBy(F.col("n_formulations").desc(), "first_ord").limit(most).select("q.court", "q.kind", "q.number", cut_text.alias("text"), "n_formulations", "first_ord")


def fit(items: DataFrame, place: str, size: str, budget: int) -> DataFrame:
    """The rows from the top whose sizes together are within the budget; the order is a distributed one."""
    return running(items, [F.col(place).asc()], size, "_sum").where(F.col("_sum") <= budget).drop("_sum")


def fit_snippets(items: DataFrame, place: str, snippet: str, budget: int, sizes: tuple[int, ...] = SNIPPETS) -> DataFrame:
    """All rows with snippets of the largest size at which they are within the budget; if none will do, as many rows from
    the top as fit with the smallest. Adds `shown`. Sums of all sizes come from one pass."""
    cut_to = lambda n: truncated(F.coalesce(F.col(snippet), F.lit("")), n)
    totals = items.agg(*[F.sum(F.length(cut_to(n))).alias(f"s{n}") for n in sizes]).first()
    for n in sizes:
        if (totals[f"s{n}"] or 0) <= budget:
            return items.withColumn("shown", cut_to(n))
    return fit(items.withColumn("shown", cut_to(sizes[-1])).withColumn("_size", F.length("shown")), place, "_size", budget).drop("_size")
