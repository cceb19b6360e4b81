"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Native: every step is a built-in function on one row, so there is no shuffle. Places of matches come
from the lengths of the pieces between them (`split`) and of the matches (`regexp_extract_all`).

Entropy: a candidate is a maximal run of base64 or base64url characters, `WINDOW` or more, with a letter
(numbers are no keys). A window of `WINDOW` characters slides over it; its counts per character are changed
by the character that enters and the one that leaves, and with them the sum of n * log2(n), held in
millionths of a bit as an integer, so no error builds up. The entropy is log2(WINDOW) less that sum
over WINDOW. Each character class (hex; letters of both cases; letters of one case and digits; letters of
one case without a digit, or joined by - or _, as words are) has its threshold. UUIDs are taken out first.
Candidates on the allow list (placeholder words, runs of one character) and those that
overlap a pattern's match add no span.

Defined cases: null and empty texts have no spans; rows are independent, so repeated rows, ties and
null ids need no rule; extra columns are kept by `find_secrets` and `redact_secrets`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
ALLOWED = r"(?:[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]|0{8}|1{8}|[Xx]{8}|1234567890|abcdefghij|ABCDEFGHIJ)"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
TOKEN_ALPHABET = ALPHABET + "-_"
UUID = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"
#: Bits of entropy that the best window must reach, by class.
THRESHOLDS = {"hex": 3.0, "one_case": 3.5, "mixed": 3.7, "words": 3.8}
#: n * log2(n) in millionths of a bit.
NLOGN = [round(n * math.log2(n) * 1e6) if n else 0 for n in range(WINDOW + 1)]


def _most(bits: float) -> int:
    """Largest sum of n * log2(n) of a window with that entropy or more."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1e6)


def _matches(text: Column, pattern: str, keep, group: int = 0) -> Column:
    """array<struct<start int, end int>> of the leftmost non-overlapping matches that keep(match, group's text) holds for."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("piece"), hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("own"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, x):
        start = acc["pos"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("pos"), F.when(keep(x["hit"], x["own"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(empty)


def window_sum(candidate: Column) -> Column:
    """Least sum of n * log2(n), in millionths, of the windows of a string: incremental counts."""
    chars = F.transform(F.split(candidate, ""), lambda c: F.call_function("locate", c, F.lit(TOKEN_ALPHABET)))
    table_ = F.array(*[F.lit(x).cast("bigint") for x in NLOGN])
    at = lambda n: F.element_at(table_, n + F.lit(1))
    shifted = F.concat(F.array_repeat(F.lit(0), WINDOW), chars)
    steps = F.arrays_zip(chars.alias("new"), F.slice(shifted, F.lit(1), F.size(chars)).alias("old"), F.sequence(F.lit(1), F.size(chars)).alias("n"))
    zero = F.struct(F.array_repeat(F.lit(0), len(TOKEN_ALPHABET)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(2**62).cast("bigint").alias("best"))

    def step(acc, x):
        same = x["new"] == x["old"]
        enters = F.element_at(acc["counts"], x["new"])
        leaves = F.when(x["old"] > 0, F.element_at(acc["counts"], F.greatest(x["old"], F.lit(1)))).otherwise(F.lit(1))
        total = acc["sum"] + F.when(same, F.lit(0).cast("bigint")).otherwise(at(enters + 1) - at(enters) + F.when(x["old"] > 0, at(leaves - 1) - at(leaves)).otherwise(F.lit(0).cast("bigint")))
        counts = F.transform(acc["counts"], lambda c, j: (c + F.when(j + 1 == x["new"], 1).otherwise(0) - F.when(j + 1 == x["old"], 1).otherwise(0)).cast("int"))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(x["n"] >= WINDOW, F.least(acc["best"], total)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(steps, zero, step)["best"]


def _high_entropy(hit: Column) -> Column:
    c = F.regexp_replace(hit, UUID, "-")
    bits = lambda kind: F.lit(_most(THRESHOLDS[kind]))
    limit = F.when(c.rlike("^[0-9a-fA-F]+$"), bits("hex")).when(c.rlike("[a-z]") & c.rlike("[A-Z]"), bits("mixed")).when(c.rlike("[0-9]") & ~c.rlike("[_-]"), bits("one_case")).otherwise(bits("words"))
    return F.when(c.rlike("[A-Za-z]") & ~c.rlike(ALLOWED), window_sum(c) <= limit).otherwise(F.lit(False))


NAMES = ("assigns", "accesses", "hexes", "entropies")


def find_secrets(docs: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Adds an array of struct(start, end) for each kind, in code points, end exclusive; columns of those names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumns(
        {
            names[0]: _matches(text, ASSIGN, lambda hit, own: F.length(own) >= 6, 2),
            names[1]: _matches(text, ACCESS.replace("+", "{16,}"), lambda hit, own: F.length(hit) >= 20),
            names[2]: _matches(text, HEX.replace("+", "{24,}"), lambda hit, own: F.length(hit) >= 24),
            names[3]: _matches(text, TOKEN, lambda hit, own: _high_entropy(hit)),
        }
    )
    known = F.concat(*names[:3])
    clear = F.filter(names[3], lambda e: ~F.exists(known, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return base.withColumn(names[3], F.when(F.size(names[3]) > 0, clear).otherwise(F.col(names[3])))


def _ordered(names: tuple[str, ...]) -> Column:
    """All spans by start, then by kind."""

    def named(n: int) -> Column:
        return F.transform(names[n], lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[named(n) for n in range(len(names))]))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of the text replaced by a mark; overlapping spans make one; other columns stay, a null text stays null."""
    own = tuple(f"__{n}" for n in NAMES)
    found = find_secrets(docs, own).withColumn("__spans", _ordered(own))

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    done = F.aggregate("__spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text"))).select(docs.columns)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", size("assigns").alias("n_assign"), size("accesses").alias("n_access"), size("hexes").alias("n_hex"), F.sha2(_said(_ordered(NAMES[:3])), 256).alias("base_sha256"), _said(_ordered(NAMES)).alias("spans"))


def _sql_matches(pattern: str, keep: str, group: int = 0) -> str:
    q = pattern.replace("'", "''")
    return f"""(SELECT list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INTEGER), 'h': h[i], 'g': g[i]}}), lambda m: {keep}) FROM (SELECT regexp_extract_all(t, '{q}') AS h, string_split_regex(t, '{q}') AS p, regexp_extract_all(t, '{q}', {group}) AS g))"""


_BETWEEN = UUID.replace("(?<![0-9A-Za-z])", "(^|[^0-9A-Za-z])").replace("(?![0-9A-Za-z])", "([^0-9A-Za-z]|$)")  # no look-around there
_CLEAR = f"regexp_replace(regexp_replace(m.h, '{_BETWEEN}', '\\1-\\2', 'g'), '{_BETWEEN}', '\\1-\\2', 'g')"
_WINDOWS = f"list_min(list_transform(range(1, length(c) - {WINDOW - 2}), lambda a: list_sum(list_transform(range(1, {len(TOKEN_ALPHABET) + 1}), lambda j: ([{', '.join(map(str, NLOGN))}])[1 + {WINDOW} - length(replace(substr(c, a, {WINDOW}), substr('{TOKEN_ALPHABET}', j, 1), ''))]))))"
_LIMIT = f"CASE WHEN regexp_matches(c, '^[0-9a-fA-F]+$') THEN {_most(THRESHOLDS['hex'])} WHEN regexp_matches(c, '[a-z]') AND regexp_matches(c, '[A-Z]') THEN {_most(THRESHOLDS['mixed'])} WHEN regexp_matches(c, '[0-9]') AND NOT regexp_matches(c, '[_-]') THEN {_most(THRESHOLDS['one_case'])} ELSE {_most(THRESHOLDS['words'])} END"
_HIGH = f"list_transform([{_CLEAR}], lambda c: regexp_matches(c, '[A-Za-z]') AND NOT regexp_matches(c, '{ALLOWED}') AND {_WINDOWS} <= {_LIMIT})[1]"
_KIND = "list_transform({c}, lambda m: {{'s': m.s, 'k': {n}, 'e': CAST(m.s + length(m.h) AS INTEGER)}})"
_JOIN = "array_to_string(list_transform(list_sort({c}), lambda m: (['assign', 'access', 'hex', 'entropy'])[m.k + 1] || ':' || m.s || ':' || m.e), ',')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {_sql_matches(ASSIGN, "length(m.g) >= 6", 2)} AS a, {_sql_matches(ACCESS, "length(m.h) >= 20")} AS b, {_sql_matches(HEX, "length(m.h) >= 24")} AS c, {_sql_matches(TOKEN, _HIGH)} AS e FROM d),
k AS (SELECT doc_id, a, b, c, list_concat(list_concat({_KIND.format(c='a', n=0)}, {_KIND.format(c='b', n=1)}), {_KIND.format(c='c', n=2)}) AS base, {_KIND.format(c='e', n=3)} AS e FROM f),
x AS (SELECT *, list_filter(e, lambda y: len(list_filter(base, lambda z: z.s < y.e AND y.s < z.e)) = 0) AS extra FROM k)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(b) AS BIGINT) AS n_access, CAST(len(c) AS BIGINT) AS n_hex, sha256({_JOIN.format(c='base')}) AS base_sha256, {_JOIN.format(c='list_concat(base, extra)')} AS spans FROM x
"""
