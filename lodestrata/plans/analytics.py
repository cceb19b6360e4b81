"""Aggregations, comparisons, joins and classifications over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.staging import spread
from ..operators import classify, evaluate, joins, panorama, snapshot

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("court"), F.when(i % 9 != 0, F.concat(F.lit("20"), F.lpad((i % 12 + 10).cast("string"), 2, "0"), F.lit("-05-01"))).alias("day"), F.when(i % 10 != 0, F.col("source")).alias("body"), F.when(i % 8 != 0, F.concat(F.lit("rel "), (F.col("n_chars") % 40).cast("string"))).alias("rapporteur"))


_SAMPLE = """s AS (SELECT doc_id, lang AS court, CASE WHEN doc_id % 9 <> 0 THEN '20' || lpad(CAST(doc_id % 12 + 10 AS VARCHAR), 2, '0') || '-05-01' END AS day, CASE WHEN doc_id % 10 <> 0 THEN source END AS body, CASE WHEN doc_id % 8 <> 0 THEN 'rel ' || (n_chars % 40) END AS rapporteur FROM documents),
c AS (SELECT 'court' AS list, NULL AS court, court AS name, count(*) AS n FROM s GROUP BY court UNION ALL SELECT 'year', NULL, coalesce(substr(day, 1, 4), '(sem data)'), count(*) FROM s GROUP BY 3
 UNION ALL SELECT 'body', court, coalesce(body, '(sem órgão)'), count(*) FROM s GROUP BY 2, 3 UNION ALL SELECT CASE WHEN rapporteur IS NULL THEN 'no_rapporteur' ELSE 'rapporteur' END, court, coalesce(rapporteur, ''), count(*) FROM s GROUP BY 1, 2, 3)"""


@register(f"WITH {_SAMPLE} SELECT list, court, name, n FROM c")
def panorama_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by court, year, body and rapporteur in one pass."""
    return panorama.counts(_sample(spark, sf_dir), key="doc_id", court="court", date="day", body="body", rapporteur="rapporteur")


@register(f"WITH {_SAMPLE}, r AS (SELECT *, row_number() OVER (PARTITION BY list, court ORDER BY n DESC, name) <= 5 AS shown FROM c) SELECT list, court, CASE WHEN shown THEN name END AS name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3")
def panorama_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the most frequent names and the rest."""
    return panorama.top_names(panorama.counts(_sample(spark, sf_dir), key="doc_id", court="court", date="day", body="body", rapporteur="rapporteur"), 5)


@register("""WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
s AS (SELECT o_custkey, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY o_custkey) SELECT s.o_custkey, s.month FROM s ANTI JOIN m ON s.o_custkey = m.o_custkey AND s.month = m.month""")
def month_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without a row between the first and the last, by customer."""
    return panorama.missing_months(t(spark, sf_dir, "orders"), "o_orderdate", "o_custkey")


@register("""WITH r AS (SELECT l_partkey % 40 AS law, CAST(l_linenumber AS BIGINT) AS article, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_returnflag END AS detail, l_orderkey AS id FROM lineitem)
SELECT law, article, detail, count(DISTINCT id) AS n, md5(string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR))) AS ids FROM r GROUP BY 1, 2, 3""")
def device_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law, article, detail and the decisions that name them."""
    r = t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("law"), F.col("l_linenumber").cast("long").alias("article"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("detail"), F.col("l_orderkey").cast("string").alias("id"))
    return r.groupBy("law", "article", "detail").agg(F.countDistinct("id").alias("n"), F.md5(F.concat_ws(",", F.array_sort(F.collect_set("id")))).alias("ids"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    old = o.where(k % 10 != 0).withColumn("o_totalprice", F.when(k % 4 != 0, F.col("o_totalprice")))
    new = o.where(k % 11 != 0).withColumn("o_totalprice", F.when(k % 4 != 0, F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    return old, new


_VERSIONS = """a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS p FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END END AS p FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.p IS NOT DISTINCT FROM b.p THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


@register(f"WITH {_VERSIONS} SELECT * FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed, null-safe comparison of two versions."""
    return snapshot.compare(*_versions(spark, sf_dir), ["o_orderkey"])


@register(f"WITH {_VERSIONS}, n AS (SELECT count(*) FILTER (WHERE change <> 'added') AS n_old, count(*) FILTER (WHERE change = 'removed') AS n_removed, count(*) FILTER (WHERE change = 'added') AS n_added, count(*) FILTER (WHERE change = 'changed') AS n_changed FROM d) SELECT *, CASE WHEN n_removed > 0 THEN 'lost_rows' WHEN n_old > 0 AND n_changed >= 20 AND n_changed >= 0.25 * n_old THEN 'large_change' END AS refused FROM n")
def snapshot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the new version may be published."""
    return snapshot.guard(snapshot.compare(*_versions(spark, sf_dir), ["o_orderkey"]))


@register("SELECT c_nationkey AS theme, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments, count(DISTINCT c_nationkey % 3) > 1 AS conflict, min(c_nationkey % 3) AS kind FROM customer GROUP BY c_nationkey")
def merged_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal but for one field become one."""
    rows = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("theme"), (F.col("c_nationkey") % 3).alias("kind"), F.col("c_mktsegment").alias("segments"))
    return snapshot.merge_repeated(rows, ["theme"], "segments").withColumn("segments", F.concat_ws(",", "segments"))


_SHOWN = "sh AS (SELECT d.doc_id, lang AS court, source AS thesis, quality = 1 AS relevant FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@register(f"WITH {_SHOWN} SELECT court, thesis, count(*) AS n_shown, count(*) FILTER (WHERE relevant) AS n_relevant, count(DISTINCT CASE WHEN relevant THEN doc_id END) AS n_found, round(count(*) FILTER (WHERE relevant) / count(*), 9) AS precision FROM sh GROUP BY ROLLUP (court, thesis)")
def precision_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision by court and thesis, by court, and over all."""
    shown = t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("court"), F.col("source").alias("thesis")).join(t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant")), "doc_id")
    return evaluate.precision(shown, ["court", "thesis"], "relevant", "doc_id").withColumn("precision", F.round("precision", 9))


_VOTES = "v AS (SELECT o_orderkey AS id, substr('SPCN', CAST(o_orderkey % 4 + 1 AS INTEGER), 1) AS a, substr('SPCN', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS b, CASE WHEN o_orderkey % 5 <> 0 THEN substr('SPCN', CAST((o_orderkey + o_custkey) % 4 + 1 AS INTEGER), 1) END AS c, o_orderpriority AS thesis FROM orders)"


@register(f"WITH {_VOTES}, m AS (SELECT thesis, CASE WHEN a = b THEN a WHEN c IS NOT NULL AND (c = a OR c = b) THEN c END AS verdict FROM v) SELECT thesis, verdict, count(*) AS n FROM m GROUP BY ALL")
def jury_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of two votes, or three."""
    letter = lambda c: F.substring(F.lit("SPCN"), (c % 4 + 1).cast("int"), F.lit(1))
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    verdict = evaluate.majority(letter(k), letter(u), F.when(k % 5 != 0, letter(k + u)))
    return t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("thesis"), verdict.alias("verdict")).groupBy("thesis", "verdict").agg(F.count(F.lit(1)).alias("n"))


@register("WITH m AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INTEGER)) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels) SELECT n, round(po, 9) AS po, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa FROM m")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa."""
    return evaluate.kappa(t(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("po", 9).alias("po"), F.round("kappa", 9).alias("kappa"))


@register("""WITH r AS (SELECT lang, n_chars < 800 AS w, quality = 0 AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT lang, count(*) FILTER (WHERE w AND b) AS tp, count(*) FILTER (WHERE w AND NOT b) AS fp, count(*) FILTER (WHERE NOT w AND b) AS fn, count(*) FILTER (WHERE NOT w AND NOT b) AS tn FROM r GROUP BY lang)
SELECT *, CASE WHEN tp + fp <> 0 THEN round(tp / (tp + fp), 9) END AS precision, CASE WHEN tp + fn <> 0 THEN round(tp / (tp + fn), 9) END AS recall, CASE WHEN fp + tn <> 0 THEN round(fp / (fp + tn), 9) END AS false_alarm FROM c""")
def warning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and false alarms of a warning."""
    r = t(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") < 800).alias("w")).join(t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("b")), "doc_id")
    out = evaluate.confusion(r, ["lang"], "w", "b")
    return out.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "false_alarm")])


@register("SELECT event_type, count(value) AS n, round(median(value), 9) AS median, round(quantile_disc(value, 0.95), 9) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile by nearest rank."""
    out = evaluate.quantiles(t(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("median", 9).alias("median"), F.round("p95", 9).alias("p95"))


@register("""WITH v AS (SELECT floor(o_totalprice / 1000) AS x, o_orderstatus = 'F' AS side FROM orders), g AS (SELECT x, count(*) AS tt, count(*) FILTER (WHERE side) AS a FROM v GROUP BY x),
r AS (SELECT *, coalesce(sum(tt) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (tt + 1) / 2 AS rk FROM g),
s AS (SELECT CAST(sum(a) AS BIGINT) AS na, CAST(sum(tt - a) AS BIGINT) AS nb, sum(a * rk) AS ra, sum(CAST(tt AS DOUBLE) * tt * tt - tt) AS ties FROM r), u AS (SELECT *, ra - na * (na + 1) / 2 AS u, CAST(na + nb AS DOUBLE) AS n FROM s)
SELECT na, nb, round(u, 3) AS u, round((u - na * nb / 2) / sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM u""")
def rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney z with ties."""
    rows = t(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderstatus") == "F").alias("side"))
    return evaluate.mann_whitney(rows, "side", "x").select("na", "nb", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@register("WITH m AS (SELECT lang AS court, avg(quality) AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang) SELECT court, round(v, 9) AS v FROM m JOIN (VALUES ('en', 0.99), ('fr', 0.5), ('de', 0.99), ('es', 0.2)) f(court, floor) USING (court) WHERE v < floor - 0.05")
def ranking_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: groups under their floor."""
    m = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy(F.col("lang").alias("court")).agg(F.avg("quality").alias("v"))
    floors = spark.createDataFrame([("en", 0.99), ("fr", 0.5), ("de", 0.99), ("es", 0.2)], "court string, floor double")
    return evaluate.gauge(m, floors, "court", "v").select("court", F.round("v", 9).alias("v"))


@register("WITH r AS (SELECT o_custkey % 300 AS number, o_orderpriority AS class, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT k.number, k.class, min(place) AS first_place FROM (SELECT DISTINCT CAST(c_custkey % 400 AS BIGINT) AS number, '1-URGENT' AS class FROM customer) k LEFT JOIN r ON r.number = k.number AND r.class = k.class GROUP BY ALL")
def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of known items, null where they are missing."""
    ranked = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("number"), F.col("o_orderpriority").alias("class"), F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("place"))
    known = t(spark, sf_dir, "customer").select((F.col("c_custkey") % 400).alias("number"), F.lit("1-URGENT").alias("class")).distinct()
    return evaluate.first_place(known, ranked, ["number", "class"], "place")


def _identity(orders: DataFrame) -> DataFrame:
    e = orders.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + (F.col("o_orderkey") % 3) * 7).alias("b")).where("a <> b").distinct()
    return joins.identities(e)


@register()
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one thing, by the least, with long chains (no SQL twin: too slow over all orders; tested against plain Python)."""
    return _identity(t(spark, sf_dir, "orders"))


@register("SELECT a.event_id AS e, b.event_id AS p FROM events a JOIN events b ON a.event_type = 'error' AND b.event_type = 'purchase' AND a.user_id % 10 = b.user_id % 10 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two kinds within a minute."""
    e = t(spark, sf_dir, "events")
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("e"), F.col("ts").alias("ta"), (F.col("user_id") % 10).alias("ua"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("p"), F.col("ts").alias("tb"), (F.col("user_id") % 10).alias("ub"))
    return joins.within(a, b, "ta", "tb", 60, [("ua", "ub")]).select("e", "p")


def _ranges(lines: DataFrame, parts: DataFrame) -> DataFrame:
    points = lines.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 2000).alias("x"))
    ranges = parts.select(F.col("p_partkey").alias("range_id"), (F.col("p_partkey") * 3).alias("a"), (F.col("p_partkey") * 3 + F.col("p_size")).alias("b"))
    return joins.in_ranges(points, "x", ranges, "a", "b").select("l_orderkey", "l_linenumber", "range_id")


@register("SELECT l_orderkey, l_linenumber, p_partkey AS range_id FROM lineitem JOIN part ON l_partkey % 2000 BETWEEN p_partkey * 3 AND p_partkey * 3 + p_size")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside ranges."""
    return _ranges(t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part"))


def _appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    class_ = F.when(k % 4 == 0, "Embargos de Declaração Cível").when(k % 4 == 1, "Apelação")
    number = F.when(k % 6 == 0, F.concat(F.lit("AgInt no REsp "), k.cast("string"))).otherwise(F.concat(F.lit("REsp "), k.cast("string")))
    return t(spark, sf_dir, "orders").select(k.alias("ord"), F.col("o_orderpriority").alias("court"), F.when(k % 7 != 0, F.concat(F.lit("0-"), (c % 900).cast("string"))).alias("cnj"), class_.alias("class"), number.alias("number"))


@register("""WITH r AS (SELECT o_orderkey AS ord, o_orderpriority AS court, CASE WHEN o_orderkey % 7 <> 0 THEN '0' || (o_custkey % 900) END AS d, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE o_orderkey % 6 = 0 END AS appeal FROM orders)
SELECT min(ord) AS ord, court FROM r WHERE appeal AND d IS NOT NULL AND d NOT IN (SELECT d FROM r WHERE NOT appeal AND d IS NOT NULL) GROUP BY court, d""")
def lone_appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appeals whose decision was not found."""
    rows = _appeals(spark, sf_dir)
    return joins.appeals_alone(rows, rows, court="court", cnj="cnj", class_="class", number="number", order="ord").select("ord", "court")


def _cited(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    records = t(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("Proc. "), F.col("o_custkey").cast("string")).alias("number"), F.lit(None).cast("string").alias("cnj"), (k % 8 != 0).alias("has_number"), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.when(k % 6 != 0, F.col("o_orderpriority")).alias("body"))
    u = F.col("c_custkey")
    cited = customers.select(u.alias("cite"), u.cast("string").alias("number"), F.concat(F.lit("1995-03-0"), (u % 9 + 1).cast("string")).alias("date"), F.when(u % 3 != 0, F.lit("2-HIGH")).alias("body"))
    return joins.verify_cited(cited, records)


@register("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS num, o_orderkey % 8 <> 0 AS hn, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE WHEN o_orderkey % 6 <> 0 THEN lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', ' ', 'g')) ELSE '' END AS b FROM orders),
c AS (SELECT c_custkey AS cite, '1995-03-0' || (c_custkey % 9 + 1) AS date, CASE WHEN c_custkey % 3 <> 0 THEN '2 high' END AS body FROM customer),
j AS (SELECT cite, id, CASE WHEN id IS NULL THEN 0 ELSE coalesce(CAST(d <> date AS INTEGER), 0) + CASE WHEN body IS NOT NULL AND b <> '' AND b <> body THEN 1 ELSE 0 END END AS conflicts, CASE WHEN id IS NULL THEN 0 ELSE CAST(d IS NULL AS INTEGER) + CASE WHEN body IS NOT NULL AND b = '' THEN 1 ELSE 0 END END AS unchecked FROM c LEFT JOIN r ON hn AND num = cite)
SELECT cite, id, CASE WHEN id IS NULL THEN 'unverified' WHEN conflicts > 0 THEN 'conflict' ELSE 'confirmed' END AS state, conflicts, unchecked, greatest(count(id) OVER (PARTITION BY cite) - 1, 0) AS others FROM j QUALIFY row_number() OVER (PARTITION BY cite ORDER BY conflicts, unchecked, id NULLS LAST) = 1""")
def cited_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited data against records."""
    return _cited(spark, sf_dir, t(spark, sf_dir, "customer"))


@register("WITH x AS (SELECT o_custkey AS key, count(*) AS n_a FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), y AS (SELECT c_custkey AS key, count(*) AS n_b FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT key, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, CASE WHEN n_a IS NULL THEN 'not_found' ELSE 'found' END AS state_a, CASE WHEN n_b IS NULL THEN 'not_found' ELSE 'found' END AS state_b FROM x FULL JOIN y USING (key)")
def two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources side by side."""
    a = t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("key"))
    return joins.side_by_side(a, t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key")), "key")


@register("WITH a AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) END AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(b.id, a.id) AS id, coalesce(b.name, a.name) AS name, coalesce(b.seg, a.seg) AS seg FROM a FULL JOIN b ON a.id = b.id")
def overlaid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second answer over the first."""
    k, base = F.col("c_custkey"), t(spark, sf_dir, "customer")
    a = base.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    b = base.where(k % 2 == 0).select(k.alias("id"), F.when(k % 4 == 0, F.upper("c_name")).alias("name"), F.col("c_mktsegment").alias("seg"))
    return joins.overlay(a, b, "id", ["name", "seg"])


@register("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, turn, rn, 1 AS part, s AS used FROM s WHERE rn = 1 UNION ALL SELECT s.conv_id, s.turn, s.rn, CASE WHEN r.used + s.s <= 2000 THEN r.part ELSE r.part + 1 END, CASE WHEN r.used + s.s <= 2000 THEN r.used + s.s ELSE s.s END FROM r JOIN s ON s.conv_id = r.conv_id AND s.rn = r.rn + 1)
SELECT conv_id, turn, part FROM r""")
def packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns into parts of 2000 characters at most."""
    return joins.pack(t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("s")), "conv_id", "turn", "s", 2000)


@register("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def section_of_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last title at or before each row."""
    return joins.last_title(t(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "section")


_RULED = """p AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'stf' WHEN 1 THEN 'stj' ELSE 'tjx' END AS court, ['súmula vinculante', 'tema repetitivo', 'IAC', 'repercussão geral', 'súmula', 'IRDR', 'PUIL', 'outro'][CAST(o_orderkey % 8 + 1 AS INTEGER)] AS kind, o_custkey % 50 AS num, CASE WHEN o_orderkey % 3 = 0 THEN 'tese' END AS site FROM orders),
tb AS (SELECT kind, n, CASE WHEN n % 2 = 0 THEN 'tese' END AS thesis FROM (VALUES ('tema repetitivo'), ('IAC')) k(kind), range(20) r(n)),
j AS (SELECT p.*, tb.n IS NOT NULL AS it, site IS NOT NULL OR tb.thesis IS NOT NULL AS has FROM p LEFT JOIN tb ON p.kind = tb.kind AND p.num = tb.n AND p.court = 'stj')"""


@register(f"""WITH {_RULED} SELECT id, CASE WHEN kind = 'súmula vinculante' AND court = 'stf' THEN 'II' WHEN kind IN ('tema repetitivo', 'IAC') AND court = 'stj' AND has THEN 'III' END AS item,
CASE WHEN kind = 'súmula vinculante' THEN CASE WHEN court = 'stf' THEN 'site_list' ELSE 'contradictory' END WHEN kind IN ('tema repetitivo', 'IAC') THEN CASE WHEN court <> 'stj' THEN 'other_court' WHEN has AND it THEN 'table' WHEN has THEN 'site_list' WHEN it THEN 'no_thesis_in_table' ELSE 'no_thesis' END
 WHEN kind = 'repercussão geral' THEN 'unverified' WHEN kind = 'súmula' AND court = 'stf' THEN 'constitutional_matter_unknown' WHEN kind = 'súmula' AND court = 'stj' THEN 'federal_matter_unknown' WHEN kind = 'IRDR' THEN 'no_fixed_rule' WHEN kind IN ('súmula', 'PUIL') THEN 'no_source' ELSE 'unknown_kind' END AS reason FROM j""")
def precedent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precedents enriched from a table and classified by fixed rules."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(x) for x in ("súmula vinculante", "tema repetitivo", "IAC", "repercussão geral", "súmula", "IRDR", "PUIL", "outro")])
    rows = t(spark, sf_dir, "orders").select(k.alias("id"), F.when(u % 3 == 0, "stf").when(u % 3 == 1, "stj").otherwise("tjx").alias("court"), F.element_at(kinds, (k % 8 + 1).cast("int")).alias("kind"), (u % 50).cast("string").alias("num"), F.when(k % 3 == 0, "tese").alias("site"))
    n = F.col("id")
    table = spark.range(20).select(F.explode(F.array(F.lit("tema repetitivo"), F.lit("IAC"))).alias("kind"), F.lit("stj").alias("court"), n.alias("number"), F.lit("julgado").alias("status"), F.when(n % 2 == 0, "tese").alias("thesis"))
    joined = classify.enrich(rows, table, ["court", "kind"], "num")
    return joined.select("id", classify.precedent_rule(F.col("court"), F.col("kind"), F.col("site"), F.col("row")).alias("r")).select("id", "r.item", "r.reason")


@register("""SELECT o_orderkey AS id, CASE WHEN s IN ('ADI', 'ADC') AND c = 'stf' AND cl IS NULL THEN 'I' END AS item, CASE WHEN s = 'ADO' AND cl = 'Apelação' THEN 'contradictory' WHEN s IN ('ADI', 'ADC') AND cl = 'Apelação' THEN 'contradictory' WHEN s IN ('ADI', 'ADC') AND c <> 'stf' THEN 'other_court' WHEN s IN ('ADI', 'ADC') THEN 'sign' WHEN s = 'ADO' THEN 'no_source' WHEN s = 'ADI MC' THEN 'compound_sign' WHEN s IS NULL AND cl IS NULL THEN 'no_class' ELSE 'class_not_enough' END AS reason
FROM (SELECT o_orderkey, CASE o_custkey % 2 WHEN 0 THEN 'stf' ELSE 'stj' END AS c, CASE o_orderkey % 6 WHEN 0 THEN 'ADI' WHEN 1 THEN 'ADC' WHEN 2 THEN 'ADO' WHEN 3 THEN 'ADI MC' WHEN 4 THEN 'REsp' END AS s, CASE WHEN o_orderkey % 5 = 0 THEN 'Apelação' END AS cl FROM orders)""")
def decision_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions classified by fixed rules."""
    k = F.col("o_orderkey")
    sign = F.when(k % 6 == 0, "ADI").when(k % 6 == 1, "ADC").when(k % 6 == 2, "ADO").when(k % 6 == 3, "ADI MC").when(k % 6 == 4, "REsp")
    rows = t(spark, sf_dir, "orders").select(k.alias("id"), F.when(F.col("o_custkey") % 2 == 0, "stf").otherwise("stj").alias("court"), sign.alias("sign"), F.when(k % 5 == 0, "Apelação").alias("class"))
    return rows.select("id", classify.decision_rule(F.col("court"), F.col("sign"), F.col("class")).alias("r")).select("id", "r.item", "r.reason")


def _paradigms(customers: DataFrame, orders: DataFrame) -> DataFrame:
    p = customers.select((F.col("c_custkey") % 7).alias("court"), F.concat(F.lit("P  "), (F.col("c_custkey") % 90).cast("string")).alias("process"), F.lit("tema").alias("kind"), F.col("c_custkey").cast("string").alias("number"))
    d = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("court"), F.concat(F.lit("P "), (F.col("o_custkey") % 120).cast("string")).alias("number"))
    return classify.paradigm_notes(d, p, ";")


@register("""WITH p AS (SELECT c_custkey % 7 AS court, 'P ' || (c_custkey % 90) AS process, 'tema' AS kind, c_custkey AS number FROM customer) SELECT o_orderkey AS id, coalesce(string_agg(kind || ' ' || number, ';' ORDER BY kind || ' ' || number), '') AS notes FROM orders LEFT JOIN p ON court = o_orderkey % 7 AND process = 'P ' || (o_custkey % 120) GROUP BY o_orderkey""")
def paradigm_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the themes that decide like a case."""
    return _paradigms(t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders"))


_CNJ = "lpad(CAST(o_orderkey AS VARCHAR), 7, '0')"


@register(f"""WITH n AS (SELECT o_orderkey AS id, {_CNJ} || lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0') || '2020' || '8' || '27' || '0001' AS d FROM orders) SELECT id, CAST(substr(d, 1, 7) || substr(d, 10, 4) || substr(d, 14, 1) || substr(d, 15, 2) || substr(d, 17, 4) || substr(d, 8, 2) AS HUGEINT) % 97 = 1 AS valid,
CASE WHEN CAST(substr(d, 1, 7) || substr(d, 10, 11) || substr(d, 8, 2) AS HUGEINT) % 97 = 1 THEN '8.27' END AS segment FROM n""")
def process_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits and court segment of process numbers."""
    text = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit("-"), F.lpad((F.col("o_custkey") % 97).cast("string"), 2, "0"), F.lit(".2020.8.27.0001"))
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), classify.process_number(text).alias("r")).select("id", "r.valid", "r.segment")


@register("""SELECT o_orderkey AS id, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS sortable, CASE WHEN CAST(strftime(o_orderdate, '%d') AS INTEGER) % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS strict, CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01'), 0) AS INTEGER) AS age, greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01'), 0) > 90 AS is_old,
CAST(o_orderkey % 1000 + 0.5 AS DOUBLE) AS mb, CAST(least(3600000, 60000 * pow(2, o_orderkey % 9)) AS BIGINT) AS backoff FROM orders""")
def dates_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as numbers, strict dates, ages, sizes, pauses."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    br = F.date_format(d, "dd/MM/yyyy")
    odd = F.when(F.dayofmonth(d) % 2 == 0, br).otherwise(F.concat(F.lit("31/02/"), F.date_format(d, "yyyy")))
    age = classify.table_age(F.lit("1996-01-01").cast("date"), d.cast("date"))
    rows = t(spark, sf_dir, "orders").select(k.alias("id"), classify.sortable_date(br).alias("sortable"), classify.strict_date(odd).alias("strict"), age.alias("a"), classify.megabytes(F.concat((k % 1000).cast("string"), F.lit(".5 MB"))).alias("mb"), classify.backoff(k % 9 + 1).alias("backoff"))
    return rows.select("id", "sortable", "strict", F.col("a.days").alias("age"), F.col("a.old").alias("is_old"), "mb", "backoff")


@register("""SELECT o_orderkey AS id, sha256('{"court":"' || o_orderpriority || '","query":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_clerk || '"' END || ',"limit":' || (o_orderkey % 5) || '}') AS key FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM orders)""")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: keys of stored answers."""
    k = F.col("o_orderkey")
    key = classify.request_key(F.col("o_orderpriority").alias("court"), F.when(k % 3 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("query"), (k % 5).alias("limit"))
    return t(spark, sf_dir, "orders").select(k.alias("id"), key.alias("key"))
