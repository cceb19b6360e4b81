"""Passages, versions, unions and readings as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import passages
from ..functions.staging import spread
from ..operators import filters, merging, panorama
from .retrieval import FORMULATIONS, ranked_search

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


@register()
def ranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of each shown text (no SQL twin; tested against a plain search of windows)."""
    shown = ranked_search(spark, sf_dir)
    texts = t(spark, sf_dir, "documents").select("doc_id", "text")
    return texts.join(F.broadcast(shown.select("doc_id", "place")), "doc_id").select("doc_id", "place", passages.passage(F.col("text"), FORMULATIONS, 110).alias("passage"))


@register("SELECT page_id, trim(html) <> '' AND NOT ends_with(regexp_replace(html, '\\s+$', ''), '>') AS cut, regexp_matches(html, '(?is)<[a-z][^<>]*\\s(?:hidden[\\s=>/]|aria-hidden\\s*=\\s*[\"'']?true\\b|style\\s*=\\s*(?:\"[^\"]*|''[^'']*)(?:display\\s*:\\s*none|visibility\\s*:\\s*hidden))') AS hidden FROM pages")
def page_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that seem cut, or hide something."""
    return t(spark, sf_dir, "pages").select("page_id", passages.html_hints(F.col("html")).alias("h")).select("page_id", "h.cut", "h.hidden")


_BARE = "regexp_replace(strip_accents(lower({0})), '[^a-z0-9]', '', 'g')"


def _overlaps(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text")
    other = d.select((F.col("doc_id") - 7).alias("doc_id"), F.col("text").alias("target"))
    return d.join(other, "doc_id").select("doc_id", F.round(passages.overlap(F.col("text"), F.col("target")), 9).alias("share"))


@register(f"""WITH d AS (SELECT doc_id, lang, {_BARE.format('text')} AS b FROM documents), p AS (SELECT a.doc_id, a.b AS body, c.b AS target FROM d a JOIN d c ON c.doc_id = a.doc_id + 7),
k AS (SELECT doc_id, target, list_transform(range(CAST(floor(length(body) / 40) AS BIGINT)), lambda i: substr(body, i * 40 + 1, 40)) AS bl FROM p) SELECT doc_id, CASE WHEN len(bl) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(bl, lambda x: contains(target, x))) / len(bl), 9) END AS share FROM k""")
def summary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a summary's blocks that another text contains."""
    return _overlaps(t(spark, sf_dir, "documents"))


@register(r"SELECT doc_id, coalesce(list_filter(regexp_extract_all(text, '\p{L}{5,}'), lambda w: lower(w) <> 'ementa')[1], 'acórdão') AS word FROM documents")
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word by which a text is looked for."""
    return t(spark, sf_dir, "documents").select("doc_id", passages.search_word(F.col("text")).alias("word"))


@register(r"WITH p AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{00a0}\x{2028}\x{feff}]+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 80 THEN s WHEN regexp_extract(left(s, 81), '(?s)^(.+) [^ ]*$', 1) <> '' THEN rtrim(regexp_extract(left(s, 81), '(?s)^(.+) [^ ]*$', 1)) ELSE left(s, 80) END AS short FROM p")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut between words."""
    return t(spark, sf_dir, "documents").select("doc_id", passages.on_word(F.col("text"), 80).alias("short"))


@register("WITH r AS (SELECT o_orderkey AS o, o_custkey % 400 AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS a, CAST(o_totalprice / 100 AS BIGINT) AS b FROM orders), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o DESC) AS n1, CASE WHEN a IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY a, b ORDER BY o DESC) END AS n2 FROM r) SELECT o, k FROM x WHERE n1 = 1 AND n2 = 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that no later one replaces, by key or by identity."""
    k = F.col("o_orderkey")
    rows = t(spark, sf_dir, "orders").select(k.alias("o"), (F.col("o_custkey") % 400).alias("k"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("a"), F.round(F.col("o_totalprice") / 100, 0).cast("long").alias("b"))
    return merging.latest_versions(rows, "k", ["a", "b"], "o").select("o", "k")


@register("WITH u AS (SELECT doc_id % 300 AS k, text AS v, 0 AS n FROM documents UNION ALL SELECT doc_id % 500, text, 1 FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(v) DESC, n, v DESC) AS rn FROM u) SELECT k, max(v) FILTER (WHERE rn = 1) AS v, count(DISTINCT n) AS n_lists FROM r GROUP BY k")
def pooled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of several, the longest value standing."""
    d, i = t(spark, sf_dir, "documents"), F.col("doc_id")
    return merging.pool([d.select((i % 300).alias("k"), F.col("text").alias("v")), d.select((i % 500).alias("k"), F.col("text").alias("v"))], "k", "v")


@register("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k")
def arms_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one arm found, and what both did."""
    o = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return merging.only_and_both(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '1-URGENT'"), "k")


@register("SELECT o_orderkey AS k, o_orderpriority AS list, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS round FROM orders")
def dealt_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists dealt in rounds."""
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("list"))
    return merging.interleaved(rows, "list", "k").select("k", "list", "round")


@register("SELECT formulation, court, CASE WHEN row_number() OVER (ORDER BY formulation, court) <= 5 THEN 'run' ELSE 'capped' END AS state FROM range(3) r(formulation), (VALUES ('a'), ('b'), ('c')) v(court)")
def task_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five tasks run."""
    tasks = spark.range(3).select(F.col("id").alias("formulation"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("court"))
    return merging.capped(tasks, ["formulation", "court"], 5)


@register("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id % 7 = 0, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END, strftime(ts, '%Y%m%d%H%M%S') || event_id) AS INTEGER) AS place FROM events")
def movement_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements by instant, unreadable ones after, by their text."""
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    rows = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("p"), F.when(F.col("event_id") % 7 != 0, passages.loose_instant(stamp)).alias("at"), F.concat(stamp, F.col("event_id").cast("string")).alias("raw"))
    return merging.movement_order(rows, "at", "raw", "p").select("event_id", "place")


@register("SELECT event_id, date_trunc('day', ts - INTERVAL 3 HOUR) + INTERVAL 27 HOUR AS midnight FROM events")
def next_midnights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next civil midnight at UTC-3."""
    return t(spark, sf_dir, "events").select("event_id", passages.next_midnight(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("midnight"))


@register("SELECT CASE WHEN n <= 27 THEN lpad(CAST(n AS VARCHAR), 2, '0') ELSE CAST(n AS VARCHAR) END AS tr, CASE WHEN n <= 24 THEN 'trt' || n END AS labour, CASE WHEN n <= 6 THEN 'trf' || n END AS federal, (['ac', 'al', 'ap', 'am', 'ba', 'ce', 'dft', 'es', 'go', 'ma', 'mt', 'ms', 'mg', 'pa', 'pb', 'pr', 'pe', 'pi', 'rj', 'rn', 'rs', 'ro', 'rr', 'sc', 'se', 'sp', 'to'])[n] AS state FROM range(1, 31) r(n)")
def court_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts of process numbers."""
    tr = F.lpad(F.col("id").cast("string"), 2, "0")
    of = lambda j: passages.court_of(F.concat(F.lit(f"{j}."), tr))
    return spark.range(1, 31).select(tr.alias("tr"), of(5).alias("labour"), of(4).alias("federal"), F.substring(of(8), 3, 10).alias("state"))


@register("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://p/' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '-11.2020.8.09.0001' END AS page FROM orders")
def process_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of processes of one segment."""
    k = F.col("o_orderkey")
    number = F.concat(F.lpad(k.cast("string"), 7, "0"), F.when(k % 2 == 0, "-11.2020.8.09.0001").otherwise("-11.2020.8.27.0001"))
    return t(spark, sf_dir, "orders").select(k.alias("id"), passages.process_page(number, "https://p/").alias("page"))


@register("""WITH v AS (SELECT 'len<' || x AS rule, doc_id % 2 AS half, quality = 1 AS relevant FROM documents d JOIN labels l USING (doc_id), (VALUES (40), (60), (90), (400)) r(x) WHERE n_chars < x),
c AS (SELECT rule, half, count(*) AS removed, count(*) FILTER (WHERE relevant) AS lost FROM v GROUP BY 1, 2), b AS (SELECT half AS fitted_on, rule AS chosen, removed AS removed_there FROM c WHERE lost = 0 QUALIFY row_number() OVER (PARTITION BY half ORDER BY removed DESC, rule) = 1)
SELECT chosen, fitted_on, removed_there, c.half AS tried_on, c.removed, c.lost FROM b LEFT JOIN c ON c.rule = chosen WHERE c.half <> fitted_on OR c.half IS NULL""")
def safe_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rule that loses nothing in one half, tried on the other."""
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("relevant")), "doc_id")
    votes = d.withColumn("x", F.explode(F.array(*map(F.lit, (40, 60, 90, 400))))).where("n_chars < x").select(F.concat(F.lit("len<"), F.col("x").cast("string")).alias("rule"), (F.col("doc_id") % 2).alias("half"), "relevant")
    return merging.safe_rules(votes, "rule", "half", "relevant")


_NAMES = [(1, "Ana Lima (relator para o acórdão: Rui Sá)"), (2, "Ana Lima"), (3, "Ana (x) (relator para o acórdão: Rui)"), (4, " Ana (relator para o acórdão: Rui)")]


@register("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false)) v(id, writes)")
def rapporteur_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that carry the one who writes the decision."""
    return spark.createDataFrame(_NAMES, "id int, name string").select("id", panorama.writes_decision(F.col("name")).alias("writes"))


@register("SELECT doc_id, CASE WHEN length(text) < 600 AND starts_with(lower(text), 'the') THEN '' ELSE sha256(text) END AS content FROM documents")
def notices_as_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: a short notice is no content."""
    shown = filters.notice_as_content(F.col("text"), "The")
    return t(spark, sf_dir, "documents").select("doc_id", F.when(shown == "", "").otherwise(F.sha2("text", 256)).alias("content"))


@register("SELECT o_orderpriority AS court, c_name AS name, count(*) AS n, count(*) <= 3 AS caveat FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def name_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So few rows under a name that its spelling may be the reason."""
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), F.col("o_custkey") == F.col("c_custkey"))
    return panorama.name_caveat(rows.groupBy(F.col("o_orderpriority").alias("court"), "name").agg(F.count(F.lit(1)).alias("n")), "n")
