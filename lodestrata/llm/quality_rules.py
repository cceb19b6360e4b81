"""Quality rules: a table of thresholds compiled into one projection.

Native: every figure is a built-in function of one row; there is no shuffle and no user function.
Words that repeat: the 64-bit hashes of the 3-word windows are sorted with their places, windows that
equal a neighbour are kept, and the words they cover are counted from the gaps between their places.
Two unequal windows of one text share a hash with a chance of about n * n / 4e19.

Defined cases: a null text is an empty one (no words, so it fails); rows are independent, so repeated
rows, ties and null ids need no rule; extra columns are kept by `score_rules`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: Common words of English, French, German and Spanish.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "les", "et", "des", "un", "que", "der", "die", "und", "den", "das", "ist", "von", "zu", "el", "en", "los", "y", "con", "las")

#: (name, figure, least, most): a figure outside its bounds rejects the text. None: no bound.
RULES = (
    ("word_count", "n_words", 50, None),
    ("mean_word_length", "mean_word_length", 2.0, 14.0),
    ("symbols_per_word", "symbol_ratio", None, 0.3),
    ("shouted_words", "shout_ratio", None, 0.3),
    ("stop_words", "stop_ratio", 0.01, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("repeated_words", "repeat_ratio", None, 0.5),
)


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def _repeat_words(grams: str) -> Column:
    """Words covered by windows that stand twice; grams is a sorted array<struct<h, i>>."""
    g = F.col(grams)
    near = F.zip_with(
        F.zip_with(g, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0)))), lambda x, before: F.struct(x["i"].alias("i"), x["h"].alias("h"), _flag(x, before).alias("twin"))),
        F.slice(g, F.lit(2), F.greatest(F.size(g), F.lit(1))),
        lambda x, after: F.struct(x["i"].alias("i"), (x["twin"] | _flag(x, after)).alias("twin")),
    )
    return F.array_sort(F.transform(F.filter(near, lambda x: x["twin"]), lambda x: x["i"]))


def _flag(x: Column, other: Column) -> Column:
    return F.coalesce(x["h"] == other["h"], F.lit(False))


def measures(docs: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Adds the figures that the rules bound."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step1 = docs.withColumns({"_w": F.regexp_extract_all(text, F.lit(f"({WORD})")), "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))})
    w = F.col("_w")
    step2 = step1.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(list(stop_words)))).cast("long"),
            "n_shouted": ((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2).cast("long"),
            "_grams": F.array_sort(F.transform(F.arrays_zip(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))).alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))).alias("b"), F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))).alias("c")), lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))),
        }
    ).drop("_w", "_lines")
    step3 = step2.withColumn("_at", _repeat_words("_grams")).drop("_grams")
    at = F.col("_at")
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    out = step3.withColumn("n_repeat_words", covered).drop("_at")
    share = lambda a, b: _zero(F.try_divide(F.col(a), F.col(b)))
    return out.withColumns(
        {
            "mean_word_length": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "n_words"),
            "shout_ratio": share("n_shouted", "n_words"),
            "stop_ratio": share("n_stop", "n_words"),
            "dup_line_ratio": share("n_dup_lines", "n_lines"),
            "repeat_ratio": share("n_repeat_words", "n_words"),
        }
    )


def compile_rules(rules=RULES) -> Column:
    """array<string> of the names of the rules that a row breaks."""
    broken = []
    for name, figure, least, most in rules:
        bad = [c for c in ((F.col(figure) < least) if least is not None else None, (F.col(figure) > most) if most is not None else None) if c is not None]
        broken.append(F.when(reduce(lambda a, b: a | b, bad), F.lit(name)))
    return F.array_compact(F.array(*broken))


def score_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows with the figures and `broken`, the names of the rules that they break."""
    return measures(docs).withColumn("broken", compile_rules(rules))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.size("broken") == 0)).alias("kept"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ln) AS n_lines,
 len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_shouted FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3 AND n_shouted / n_words <= 0.3 AND n_stop / n_words >= 0.01 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM f
"""
