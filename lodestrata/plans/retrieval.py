"""Retrieval queries over the driver's tables: documents are the decisions, lang the court, source the body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import digits, expression_re2, formless, html_text, mended, normalise, seems_cut, stems, summary_key
from ..functions.staging import shared_folder, spread
from ..operators import dedup, filters, fusion, ranking, search

FORMULATIONS = ["thering ertion that from", "ontion indthe with ones", "que les pour dans"]
COURTS = ["en", "fr", "de", "es"]
PER_TASK, SHOWN, EACH = 60, 50, 3
MUST, MUST_NOT = [["the", "der"], ["and", "und"]], ["idiot", "moron"]
TERMS = ["the", "of the", "and"]

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def q(text: str) -> str:
    return text.replace("'", "''")


FOLDED = "strip_accents(lower(text))"
NORMAL = r"trim(regexp_replace(strip_accents(lower(text)), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))"


def matched_sql(formulation: str) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches(f, '{q(s.re2)}') AS INTEGER)" for s in stems(formulation)) + ")"


ADHERENCE = "greatest(" + ", ".join(f"{matched_sql(f)} / {float(len(stems(f)))}" for f in FORMULATIONS) + ")"
BAND = "CASE WHEN adherence >= 1 THEN 0 WHEN adherence >= 0.85 THEN 1 WHEN adherence >= 0.7 THEN 2 ELSE 3 END"
HITS = "UNION ALL ".join(f"SELECT doc_id, lang AS court, {n} AS formulation, {matched_sql(f)} AS matched FROM fo " for n, f in enumerate(FORMULATIONS))
RETRIEVED = f"""fo AS MATERIALIZED (SELECT doc_id, lang, text, {FOLDED} AS f FROM documents),
hits AS (SELECT * FROM (SELECT doc_id, court, formulation, row_number() OVER (PARTITION BY formulation, court ORDER BY matched DESC, doc_id) - 1 AS position FROM ({HITS}) WHERE matched > 0) WHERE position < {PER_TASK}),
t AS (SELECT *, (CASE court WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END * {len(FORMULATIONS)} + formulation) * {PER_TASK} + position AS ord FROM hits),
occ AS (SELECT doc_id, count(DISTINCT formulation) AS n_formulations, min(position) AS best_position, min(ord) AS first_order FROM t GROUP BY doc_id),
sc AS (SELECT occ.*, lang AS court, {ADHERENCE} AS adherence FROM occ JOIN fo USING (doc_id)),
pl AS (SELECT *, {BAND} AS band FROM sc),
placed AS (SELECT *, row_number() OVER (ORDER BY band, n_formulations DESC, best_position, first_order) AS place FROM pl)"""


@register(f"SELECT doc_id, round(adherence, 9) AS adherence, CAST(band AS INTEGER) AS band, CAST(row_number() OVER (ORDER BY band, adherence DESC, doc_id) AS INTEGER) AS place FROM (SELECT *, {BAND} AS band FROM (SELECT doc_id, {ADHERENCE} AS adherence FROM (SELECT doc_id, {FOLDED} AS f FROM documents))) QUALIFY place <= 50")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 texts nearest to the formulations."""
    rows = ranking.scored(documents(spark, sf_dir).select("doc_id", "text"), FORMULATIONS)
    best = rows.select("doc_id", "adherence", "band").orderBy("band", F.col("adherence").desc(), "doc_id").limit(50)
    place = F.row_number().over(Window.orderBy("band", F.col("adherence").desc(), "doc_id"))
    return best.select("doc_id", F.round("adherence", 9).alias("adherence"), "band", place.alias("place"))


@register(f"""WITH {RETRIEVED}, r AS (SELECT *, row_number() OVER (PARTITION BY court, band = 0 ORDER BY place) <= {EACH} AND band = 0 AS res FROM placed),
s AS (SELECT *, {SHOWN} - (sum(CAST(res AS INTEGER)) OVER ()) AS free, sum(CAST(NOT res AS INTEGER)) OVER (ORDER BY place) AS rest FROM r)
SELECT doc_id, court, CAST(n_formulations AS BIGINT) AS n_formulations, CAST(best_position AS INTEGER) AS best_position, CAST(band AS INTEGER) AS band, CAST(place AS INTEGER) AS place FROM s WHERE res OR rest <= free""")
def fusion_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole federated search, with reserved places."""
    shown = fusion.fuse(documents(spark, sf_dir), FORMULATIONS, COURTS, most=SHOWN, per_task=PER_TASK, each=EACH)
    return shown.select("doc_id", "court", "n_formulations", "best_position", "band", "place")


def _outcomes(spark: SparkSession) -> DataFrame:
    rows = [(f, c, "error" if (f, c) == (1, "fr") else "capped" if (f, c) == (2, "es") else "answered", "timeout" if (f, c) == (1, "fr") else "page cap" if (f, c) == (2, "es") else None) for c in COURTS for f in range(len(FORMULATIONS)) if (f, c) != (0, "de")]
    return spark.createDataFrame(rows, "formulation int, court string, status string, reason string")


_STATE = """tk AS (SELECT f AS formulation, c AS court FROM range(3) r(f), (VALUES ('en'), ('fr'), ('de'), ('es')) v(c)),
st AS (SELECT *, CASE WHEN formulation = 0 AND court = 'de' THEN NULL WHEN formulation = 1 AND court = 'fr' THEN 'error' WHEN formulation = 2 AND court = 'es' THEN 'capped' ELSE 'answered' END AS status,
 CASE WHEN formulation = 1 AND court = 'fr' THEN 'timeout' WHEN formulation = 2 AND court = 'es' THEN 'page cap' END AS reason FROM tk),
ok AS (SELECT t.* FROM t JOIN st USING (formulation, court) WHERE status = 'answered')"""


@register(f"""WITH {RETRIEVED}, {_STATE}, n AS (SELECT formulation, court, count(*) AS n FROM ok GROUP BY ALL)
SELECT court, count(*) AS n_tasks, count(*) FILTER (WHERE status = 'answered') AS n_answered, count(*) FILTER (WHERE status = 'answered' AND n IS NULL) AS n_empty, count(*) FILTER (WHERE status = 'error') AS n_error,
 count(*) FILTER (WHERE status = 'capped') AS n_capped, count(*) FILTER (WHERE status IS NULL) AS n_not_run, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons,
 coalesce(any_value(d.nf), 0) AS n_found, coalesce(any_value(d.nf), 0) AS n_shown
FROM st LEFT JOIN n USING (formulation, court) LEFT JOIN (SELECT court, count(DISTINCT doc_id) AS nf FROM ok GROUP BY court) d USING (court) GROUP BY court""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered, empty, failed, capped and not run are five states, never one."""
    hits = fusion.retrieve(documents(spark, sf_dir), FORMULATIONS, COURTS, key="doc_id", court="lang", text="text", most=PER_TASK)
    out = fusion.require_answer(_outcomes(spark))
    hits = hits.join(out.where("status = 'answered'").select("formulation", "court"), ["formulation", "court"])
    return fusion.coverage(fusion.tasks(spark, FORMULATIONS, COURTS), out, hits, hits.select("court", "doc_id").distinct())


@register(f"""WITH {RETRIEVED}, {_STATE} SELECT formulation FROM st WHERE formulation NOT IN (SELECT formulation FROM ok) GROUP BY formulation HAVING count(*) FILTER (WHERE status = 'answered') = count(*)""")
def barren_formulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found nothing although every court answered."""
    hits = fusion.retrieve(documents(spark, sf_dir), FORMULATIONS, COURTS, key="doc_id", court="lang", text="text", most=PER_TASK)
    out = _outcomes(spark)
    hits = hits.join(out.where("status = 'answered'").select("formulation", "court"), ["formulation", "court"])
    return fusion.barren(fusion.tasks(spark, FORMULATIONS, COURTS), out, hits).select(F.col("formulation").cast("long").alias("formulation"))


@register("""WITH q AS (SELECT o_custkey % 5 AS formulation, c_mktsegment AS court, o_orderpriority AS kind, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS VARCHAR) END AS number, o_orderpriority || ' ' || repeat('text ', 70) AS text, o_orderkey AS ord FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT arg_min(court, ord) AS court, arg_min(kind, ord) AS kind, arg_min(coalesce(number, '-'), ord) AS number, arg_min(text, ord) AS text, count(DISTINCT formulation) AS n_formulations, min(ord) AS first_ord FROM q GROUP BY court || '|' || kind || '|' || coalesce(number, text))
SELECT court, kind, nullif(number, '-') AS number, left(text, 300) || '…' AS text, n_formulations, first_ord FROM g ORDER BY n_formulations DESC, first_ord LIMIT 10""")
def qualified_precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without repeats, by how many formulations brought them, ten at most."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    number = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 40).cast("string"))
    rows = o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_custkey") % 5).alias("formulation"), F.col("c_mktsegment").alias("court"), F.col("o_orderpriority").alias("kind"), number.alias("number"), F.concat("o_orderpriority", F.lit(" " + "text " * 70)).alias("text"), F.col("o_orderkey").alias("ord"))
    return fusion.qualified(rows)


_RECORDS = """r AS (SELECT doc_id, lang AS court, CASE WHEN doc_id % 11 <> 0 THEN source END AS body, CASE WHEN doc_id % 13 <> 0 THEN '2024-01-' || lpad(CAST(length(text) % 28 + 1 AS VARCHAR), 2, '0') END AS day,
 CASE WHEN doc_id % 7 <> 0 THEN 'Ap ' || CAST(length(text) % 3 AS VARCHAR) END AS number, CASE WHEN doc_id % 5 <> 0 THEN 'https://x/' || doc_id END AS link, text, doc_id % 50 AS position FROM documents)"""
_SUMMARY = r"lower(regexp_replace(regexp_replace(trim(text), '(?i)^ementa\s*:\s*', ''), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))"


def _records(docs: DataFrame) -> DataFrame:
    i, n = F.col("doc_id"), F.length("text")
    return docs.select(
        "doc_id",
        F.col("lang").alias("court"),
        F.when(i % 11 != 0, F.col("source")).alias("body"),
        F.when(i % 13 != 0, F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).alias("day"),
        F.when(i % 7 != 0, F.concat(F.lit("Ap "), (n % 3).cast("string"))).alias("number"),
        F.when(i % 5 != 0, F.concat(F.lit("https://x/"), i.cast("string"))).alias("link"),
        "text",
        (i % 50).alias("position"),
    )


@register(f"""WITH {_RECORDS}, k AS (SELECT *, {_SUMMARY} AS s, regexp_replace(number, '[^0-9]', '', 'g') AS num FROM r),
g AS (SELECT *, CASE WHEN day IS NOT NULL AND s <> '' THEN court || '|' || day || '|' || sha256(s) ELSE 'alone:' || doc_id END AS grp FROM k),
n AS (SELECT grp, count(DISTINCT num) AS c FROM g GROUP BY grp),
f AS (SELECT *, CASE WHEN c <= 1 THEN grp WHEN num IS NULL THEN 'alone:' || doc_id ELSE grp || '|' || num END AS fin FROM g JOIN n USING (grp)),
o AS (SELECT *, row_number() OVER (PARTITION BY fin ORDER BY (num IS NOT NULL) DESC, (coalesce(body, '') <> '') DESC, (coalesce(link, '') <> '') DESC, position, doc_id) AS rn FROM f)
SELECT max(doc_id) FILTER (WHERE rn = 1) AS survivor, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n_copies, min(position) AS best_position, count(DISTINCT day) > 1 AS dates_differ FROM o GROUP BY fin""")
def equivalent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of one decision, the most complete standing for it."""
    out = dedup.equivalents(_records(documents(spark, sf_dir)), key="doc_id", court="court", date="day", text="text", number="number", body="body", link="link", position="position")
    return out.select("survivor", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), "n_copies", "best_position", "dates_differ")


@register(rf"""WITH {_RECORDS}, k AS (SELECT doc_id, CASE WHEN body IS NOT NULL AND number IS NOT NULL AND {NORMAL.replace('strip_accents(lower(text))', 'text')} <> '' THEN sha256(court || chr(1) || body || chr(1) || number || chr(1) || {NORMAL.replace('strip_accents(lower(text))', 'text')}) ELSE 'alone:' || doc_id END AS key FROM r)
SELECT min(doc_id) AS first, count(*) AS n, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE doc_id <> m), '') AS others FROM (SELECT *, min(doc_id) OVER (PARTITION BY key) AS m FROM k) GROUP BY key""")
def series_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: rulings of one court, body and rapporteur with one summary."""
    out = dedup.series(_records(documents(spark, sf_dir)), key="doc_id", court="court", body="body", rapporteur="number", text="text", order="doc_id")
    return out.select("first", "n", F.concat_ws(",", F.transform("others", lambda x: x.cast("string"))).alias("others"))


_HAS = lambda t: f"regexp_matches(n, '{q(expression_re2(t))}')"
_PASS = " AND ".join("(" + " OR ".join(map(_HAS, g)) + ")" for g in MUST) + "".join(f" AND NOT {_HAS(t)}" for t in MUST_NOT)


@register(f"SELECT lang AS court, CASE WHEN trim(text) = '' THEN 'no_text' WHEN {_PASS} THEN 'passed' ELSE 'excluded' END AS filter_status, count(*) AS n FROM (SELECT lang, text, {NORMAL} AS n FROM documents) GROUP BY ALL")
def local_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of synonyms and exclusions over whole expressions, in three outcomes."""
    split = filters.split_by_filter(documents(spark, sf_dir).select("lang", "text"), "text", MUST, MUST_NOT)
    return split.groupBy(F.col("lang").alias("court"), "filter_status").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_excluded, count(*) FILTER (WHERE o_orderstatus <> 'F' AND lower(c_mktsegment) = 'building' AND lower(o_orderpriority) LIKE '%high%') AS n_kept FROM orders JOIN customer ON o_custkey = c_custkey")
def status_and_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metadata filters, and exclusion by status with its count."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = o.select("o_custkey", "o_orderstatus", "o_orderpriority").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    ok = filters.metadata("Building", "HIGH", None, ("c_mktsegment", "o_orderpriority", "o_orderpriority"))
    out = F.col("o_orderstatus") == "F"
    return rows.agg(F.count_if(out).alias("n_excluded"), F.count_if(~out & ok).alias("n_kept"))


@register(f"WITH {_RECORDS} SELECT missing, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN coalesce(body, '') = '' THEN 'orgao' END, CASE WHEN coalesce(day, '') = '' THEN 'data' END, CASE WHEN coalesce(link, '') = '' THEN 'link' END) AS missing FROM r) GROUP BY missing")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a record lacks, in fixed order."""
    rows = _records(documents(spark, sf_dir)).drop("text")
    lack = filters.missing([("orgao", F.col("body")), ("data", F.col("day")), ("link", F.col("link"))])
    return rows.groupBy(F.array_join(lack, ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@register(r"SELECT page_id, host = 'example.net' OR host LIKE '%.example.net' AS official FROM (SELECT page_id, lower(regexp_extract(url, '^https://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages)")
def official_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """https and on the domain or under it."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", filters.on_host(F.col("url"), "example.net").alias("official"))


@register(r"""WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\n\s*\n\s*\([^\n]*\)\s*$', ''), '^\s+|\s+$', '', 'g')) AS t FROM documents)
SELECT doc_id, t <> '' AND (regexp_matches(t, '[.;:!?]\s+(?:[IVXLC]+|\d{1,3})[.)]$') OR (NOT regexp_matches(t, '[.!?…"”»)\]]$') AND NOT regexp_matches(t, '(?i)\n[^\n]{0,60}\b(?:relatora?|desembargadora?|juiz|juíza|ministr[oa])\s*$'))) AS seems_cut FROM b""")
def cut_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """summaries that stop in the middle."""
    return documents(spark, sf_dir).select("doc_id", seems_cut(F.col("text")).alias("seems_cut"))


_TIES = "i AS (SELECT o_orderkey AS k, o_orderpriority AS court, CAST(o_custkey % 3 AS INTEGER) AS band, CAST(o_custkey % 4 AS INTEGER) AS n_formulations, CAST(o_custkey % 5 AS INTEGER) AS best_position, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS rel FROM orders)"


@register(f"""WITH {_TIES}, s AS (SELECT *, row_number() OVER (PARTITION BY band, n_formulations, best_position, court ORDER BY k) AS slot, row_number() OVER (PARTITION BY band, n_formulations, best_position, court ORDER BY rel DESC NULLS LAST, k) AS want FROM i)
SELECT a.k AS k, row_number() OVER (ORDER BY a.band, a.n_formulations DESC, a.best_position, b.k) AS place FROM s a JOIN s b ON a.band = b.band AND a.n_formulations = b.n_formulations AND a.best_position = b.best_position AND a.court = b.court AND a.want = b.slot""")
def tie_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a tie each court keeps its slots and fills them by relevance."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = F.col("o_custkey")
    rows = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("court"), (c % 3).cast("int").alias("band"), (c % 4).cast("int").alias("n_formulations"), (c % 5).cast("int").alias("best_position"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("rel"))
    return ranking.ordered(rows, "court", "k", "rel", bounded=False).select("k", "place")


@register("SELECT o_orderkey AS k, row_number() OVER (ORDER BY d NULLS LAST, o_orderkey) AS date_place, CAST(count(*) FILTER (WHERE d IS NULL) OVER () AS BIGINT) AS n_undated FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)")
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: oldest first, undated last as they came, with their count."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("s/d")).alias("d"))
    n = rows.agg(F.count_if(F.col("d") == "s/d").alias("n_undated"))
    return ranking.by_date(rows, "d", "k", bounded=False).select("k", "date_place").crossJoin(F.broadcast(n))


_POS = rf"""d AS (SELECT doc_id, {NORMAL} AS n FROM documents),
w AS (SELECT doc_id, regexp_extract_all(n, '([^\p{{L}}\p{{N}}]*)([\p{{L}}\p{{N}}]+)', 2) AS ws, regexp_extract_all(n, '([^\p{{L}}\p{{N}}]*)([\p{{L}}\p{{N}}]+)', 1) AS gs FROM d),
e AS (SELECT doc_id, unnest(ws) AS term, unnest(gs) AS gap, unnest(range(len(ws))) AS i FROM w),
x AS (SELECT doc_id, term, CAST(sum(CASE WHEN i = 0 THEN 0 WHEN gap = ' ' THEN 1 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS position FROM e)"""


@register(f"WITH {_POS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n, CAST(sum(position) AS BIGINT) AS place_sum FROM x GROUP BY term")
def index_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional index, as its vocabulary with a checksum of places."""
    index = search.build_index(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).cast("long").alias("n"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)).alias("place_sum"))


_FOUND = " AND ".join(f"regexp_matches(n, '{q(expression_re2(t))}')" for t in TERMS)


@register(f"SELECT doc_id FROM (SELECT doc_id, {NORMAL} AS n FROM documents) WHERE {_FOUND}")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and phrases by the stored index, which the first search of a table builds; the twin scans."""
    index = search.stored_index(documents(spark, sf_dir), "doc_id", "text", shared_folder(spark))
    return search.search_index(index, "doc_id", TERMS)


_CONTEXT = f"""CASE WHEN hit > 0 THEN (CASE WHEN b > 1 THEN '…' ELSE '' END) || trim(substr(p, b, e - b)) || (CASE WHEN e <= length(p) THEN '…' ELSE '' END) END"""


@register(rf"""WITH h AS (SELECT doc_id, n_chars, regexp_replace(text, '\s+', ' ', 'g') AS p FROM (SELECT doc_id, n_chars, text, {NORMAL} AS n FROM documents) WHERE {_FOUND} ORDER BY n_chars DESC, doc_id DESC LIMIT 10),
c AS (SELECT *, instr(strip_accents(lower(p)), 'the') AS hit FROM h), k AS (SELECT *, greatest(hit - 100, 1) AS b, least(length(p) + 1, hit + 103) AS e FROM c)
SELECT doc_id, n_chars, {_CONTEXT} AS context FROM k""")
def scan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by scan, the ten best, and only then what stands around the first term."""
    hits = search.search_scan(documents(spark, sf_dir).select("doc_id", "n_chars", "text"), "text", search.read_query('the "of the" and'))
    best = search.newest(hits, "n_chars", "doc_id", "doc_id", 10)
    return best.select("doc_id", "n_chars", search.context(F.col("text"), "the").alias("context"))


@register(rf"""SELECT doc_id, sha256({NORMAL}) AS normal, sha256({_SUMMARY}) AS summary, sha256(trim(regexp_replace({FOLDED}, '[^a-z0-9]+', ' ', 'g'))) AS formless, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys by which texts are compared."""
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.sha2(normalise(t), 256).alias("normal"), F.sha2(summary_key(t), 256).alias("summary"), F.sha2(formless(t), 256).alias("formless"), digits(t).alias("digits"))


@register(rf"""SELECT page_id, sha256(text) AS text_sha, length(text) AS n FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\x{{00a0}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g'), '\n\n+', chr(10), 'g') AS text FROM (
SELECT page_id, {"replace(" * 9}regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '[\r\n]+', ' ', 'g'), '(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|blockquote|pre|title)(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'),
 '&nbsp;', ' '), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM pages))""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of pages."""
    out = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"))
    return out.select("page_id", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("long").alias("n"))


@register("SELECT doc_id, sha256(text) AS mended FROM documents")
def mended_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose UTF-8 was read as Latin-1 come back as they were."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    plain = documents(spark, sf_dir).select("doc_id", F.when(F.col("text").rlike("^[\\x00-\\x{ff}]*$"), broken).otherwise(F.col("text")).alias("t"))
    return plain.select("doc_id", F.sha2(mended(F.col("t")), 256).alias("mended"))

