"""Sources, sinks and lists as queries: what is written to the shared folder is read back."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import passages
from ..functions.staging import shared_folder, spread
from ..functions.text import truncated
from ..operators import evaluate, fusion, merging, references, snapshot
from ..sources import answers, readers, stores
from ..streaming import limits

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
    return spread(rows) if name == "documents" else rows


def _place(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of this application in the shared one, emptied first."""
    path = f"{shared_folder(spark)}/{name}_{spark.sparkContext.applicationId}_{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return path


@register("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'a \"b\" | c' ELSE '' END AS name, c_mktsegment AS segment FROM customer")
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quoted file with line breaks and separators inside values, its header checked, a column never read out."""
    path = _place(spark, sf_dir, "delimited")
    name = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, '\na "b" | c').otherwise(""))
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    rows.write.csv(path, sep="|", header=True, quote='"', escape='"', quoteAll=True)
    return readers.read_delimited(spark, path, ["id", "name", "balance", "segment"], "|", drop=("balance",))


@register("SELECT c_custkey AS page, CAST(c_custkey % 700 AS INTEGER) AS number, CASE WHEN c_custkey % 2 = 0 THEN 'cancelada' END AS mark FROM customer")
def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items of a page's list, with their marks."""
    k = F.col("c_custkey")
    html = F.concat(F.lit("<html><body><div>menu 1</div><div class='sumula-item'><b>S&uacute;mula</b> "), (k % 700).cast("string"), F.when(k % 2 == 0, " (cancelada)").otherwise(""), F.lit("</div></body></html>"))
    return readers.list_items(t(spark, sf_dir, "customer").select(k.alias("page"), html.alias("html")), "page", "html", "sumula-item").select("page", "number", "mark")


@register("SELECT s_suppkey AS k, n_name AS name, s_name AS page FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def pages_on_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined to the list that must have them all."""
    pages = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("page"))
    return merging.strict_match(pages, t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name")), "n").select("k", "name", "page")


@register("WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT sha256(CAST(user_id AS VARCHAR)) AS key, ts, event_id FROM events, m WHERE ts > now - INTERVAL 24 HOUR) SELECT key, ts AS \"at\", event_id FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, '{\"event_id\":' || event_id DESC) = 1")
def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers stored under the hash of their request, and the newest live one of each."""
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path, now = _place(spark, sf_dir, "answers"), e.agg(F.max("ts")).first()[0]
    stores.put(e.select("event_id", "user_id", "ts"), path, F.col("user_id").cast("string"), F.col("ts"))
    live = stores.get(spark, path, F.lit(now))
    return live.select("key", F.col("at").cast("timestamp_ntz").alias("at"), F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


@register("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'Z' ELSE o_orderstatus END AS v, CAST((SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS BIGINT) AS n_changed FROM orders")
def published_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version that the guard lets through, written and read back with its count of changes."""
    k, path = F.col("o_orderkey"), _place(spark, sf_dir, "snapshot")
    old = t(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderstatus").alias("v"))
    new = old.select("k", F.when(F.col("k") % 50 == 0, "Z").otherwise(F.col("v")).alias("v"))
    verdict = snapshot.publish(old, new, ["k"], path)
    return spark.read.parquet(path).join(F.broadcast(verdict.select("n_changed")))


@register("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"' || CASE WHEN n_regionkey > 1 THEN ',"r":' || n_regionkey ELSE '' END || '}' AS json FROM nation""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: rows as compact JSON, absent fields left out."""
    rows = t(spark, sf_dir, "nation").withColumn("r", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")))
    return stores.response(rows, ["n_nationkey", "n_name", "r"])


@register("SELECT o_orderkey AS ask, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS receipt, CASE WHEN o_orderkey % 4 = 3 THEN 1 WHEN o_orderkey % 4 <> 0 THEN 0 END AS way FROM orders")
def receipts_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6: the receipt of a text whose bytes are what it says: by id, else by a link that one id has; a false one is none."""
    k = F.col("o_orderkey")
    content = F.encode(F.concat(F.lit("text "), k.cast("string")), "UTF-8")
    hash_ = F.when(k % 4 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(content, 256))
    base = t(spark, sf_dir, "orders")
    receipts = base.select(k.alias("receipt"), k.cast("string").alias("id"), F.concat(F.lit("l"), k.cast("string")).alias("link"), hash_.alias("sha256"), F.length(content).alias("size"), content.alias("content"), F.col("o_orderdate").alias("at"))
    wanted = base.select(k.alias("ask"), F.when(k % 4 == 3, "none").otherwise(k.cast("string")).alias("id"), F.concat(F.lit("l"), k.cast("string")).alias("link"))
    return wanted.select("ask").join(readers.receipt_for(wanted, receipts), "ask", "left").select("ask", "receipt", "way")


@register("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Pedido número ' || o_orderkey || ' é o texto' END AS text, CASE o_orderkey % 4 WHEN 1 THEN 'not_html' WHEN 2 THEN 'bad_base64' WHEN 3 THEN 'no_text' END AS reason FROM orders")
def data_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages inside addresses, or why there is no text."""
    k = F.col("o_orderkey")
    html = F.when(k % 4 == 3, "<p>x</p>").otherwise(F.concat(F.lit("<html><style>a</style><p>Pedido n&uacute;mero "), k.cast("string"), F.lit(" &#233; o texto</p></html>")))
    url = F.concat(F.when(k % 4 == 1, "data:text/plain;base64,").otherwise("data:text/html;charset=utf-8;base64,"), F.base64(F.encode(html, "UTF-8")), F.when(k % 4 == 2, "*").otherwise(""))
    return t(spark, sf_dir, "orders").select(k.alias("k"), readers.data_address(url).alias("p")).select("k", "p.text", "p.reason")


@register("SELECT o_orderkey AS law, '/lei' || o_orderkey AS path, 'lei' || o_orderkey AS id, 0 AS depth FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, '/lei' || l_orderkey || '/art' || l_linenumber, 'art' || l_linenumber, 1 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT l_orderkey, '/lei' || l_orderkey || '/art' || l_linenumber || '/par1', 'par1', 2 FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def law_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of nested laws, depth first."""
    n = F.col("l_linenumber")
    par = F.array(F.struct(F.lit("par1").alias("legislationIdentifier")))
    part = F.struct(F.concat(F.lit("art"), n.cast("string")).alias("legislationIdentifier"), F.when(n == 1, par).alias("hasPart"))
    laws = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.collect_list(part).alias("hasPart"))
    json = F.to_json(F.struct(F.concat(F.lit("lei"), F.col("l_orderkey").cast("string")).alias("legislationIdentifier"), "hasPart"))
    return references.tree_rows(laws.select(F.col("l_orderkey").alias("law"), json.alias("j")), "law", "j")


@register("SELECT doc_id, text FROM documents")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in three character sets, said by a header, a page or nothing, read back as the text."""
    k, text = F.col("doc_id"), F.col("text")
    latin = ~text.rlike("[^\\x00-\\x7F\\u00A0-\\u00FF]")
    how = F.when((k % 3 == 0) & latin, "latin").when(k % 3 == 1, "utf16").otherwise("none")
    content = F.when(how == "latin", F.encode(text, "ISO-8859-1")).when(how == "utf16", F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8"))
    said = F.when(how == "latin", "text/html; charset=ISO-8859-1").when(how == "utf16", 'text/plain; charset="utf-16"').otherwise("text/plain")
    return t(spark, sf_dir, "documents").select("doc_id", passages.decoded(content, said).alias("text"))


@register("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '-11.2020.8.09.0001' END AS number FROM orders")
def header_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one process number before the first title; none with two, or after it."""
    k = F.col("o_orderkey")
    number = lambda c: F.concat(F.lpad(c.cast("string"), 7, "0"), F.lit("-11.2020.8.09.0001"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Autos "), number(k), F.lit("\nEMENTA\n"), number(k + 1))).when(k % 3 == 1, F.concat(number(k), F.lit(" e "), number(k + 1), F.lit("\nEMENTA\n"))).otherwise(F.concat(F.lit("Autos\nEMENTA\n"), number(k)))
    return t(spark, sf_dir, "orders").select(k.alias("k"), passages.header_number(text, r"(?m)^EMENTA$").alias("number"))


@register("SELECT doc_id, CASE WHEN length(text) > 300 THEN regexp_replace(left(text, 300), ' +$', '') || '…' ELSE text END AS short FROM documents")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a bounded length, with dots where they were cut."""
    return t(spark, sf_dir, "documents").select("doc_id", truncated(F.col("text"), 300).alias("short"))


@register("WITH s AS (SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 40 THEN regexp_replace(left(text, 40), ' +$', '') || '…' ELSE coalesce(text, '') END AS shown FROM documents), r AS (SELECT *, sum(length(shown)) OVER (ORDER BY doc_id) AS run FROM s) SELECT doc_id, shown FROM r WHERE run <= 6000")
def fitted_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the size that fits a budget, and rows from the top where none does (the budget is the feature)."""
    return fusion.fit_snippets(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 6000).select("doc_id", "shown")


@register("SELECT o_orderkey AS k, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END, o_orderpriority, o_orderkey) AS place FROM orders")
def index_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable order of an index: date, register, id; no date first."""
    k = F.col("o_orderkey")
    rows = t(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 11 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.col("o_orderpriority").alias("register"))
    return merging.index_order(rows, "date", "register", "k").select("k", F.col("place").cast("long").alias("place"))


_LOT = "CAST('0x' || left(md5({seed} || ':' || doc_id), 8) AS BIGINT)"


@register(f"WITH p AS (SELECT doc_id, lang = 'en' AS pooled FROM documents) SELECT doc_id, NOT pooled AS control, {_LOT.format(seed=8)} AS shuffle FROM p WHERE pooled OR {_LOT.format(seed=7)} % 10 = 0")
def blind_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool with a tenth of controls, in the order of a seeded lot."""
    d = t(spark, sf_dir, "documents")
    return evaluate.blind_pool(d.where("lang = 'en'").select("doc_id"), d.where("lang <> 'en'").select("doc_id"), "doc_id", 7)


@register()
def credit_brake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls under credits that the service reports (no SQL twin; tested against a plain loop)."""
    kind, left = F.col("event_type"), (F.col("event_id") * 37 % 60).cast("int")
    said = F.when(kind.isin("error", "signup"), F.concat_ws(":", F.when(kind == "signup", "release_answer").otherwise("answer"), left.cast("string"))).otherwise("call")
    e = t(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 50).alias("user_id"), said.alias("said"))

    def rule(state, at, x):
        event, _, remaining = x.partition(":")
        return limits.brake(state, at, event, int(remaining) if remaining else None)

    return limits.over_log(e, "user_id", "ts", "event_id", "said", rule)


@register("SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'no_index' WHEN 1 THEN 'no_receipt' WHEN 2 THEN 'file_changed' WHEN 3 THEN 'file_changed' WHEN 4 THEN 'content_changed' END AS reason FROM customer")
def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an index may stand for its file, or why the file is read whole."""
    k, hash_ = F.col("c_custkey"), F.sha2("c_name", 256)
    c = t(spark, sf_dir, "customer")
    files = c.select(k.alias("k"), F.when(k % 6 == 2, 11).otherwise(10).alias("bytes"), F.lit(5).alias("modified"), F.when(k % 6 == 4, F.sha2(F.lit("x"), 256)).otherwise(hash_).alias("sha256"))
    receipts = c.where(k % 6 != 1).select(k.alias("k"), F.when(k % 6 == 3, F.sha2(F.lit("y"), 256)).otherwise(hash_).alias("sha256"))
    indexes = c.where(k % 6 != 0).select(k.alias("k"), F.lit(10).alias("bytes"), F.lit(5).alias("modified"), hash_.alias("sha256"))
    return stores.index_state(files, receipts, indexes, "k")


@register("WITH x AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS n_ids, min(l_suppkey) AS best_position, list_sort(list_distinct(flatten(list([l_linenumber % 3, l_linenumber % 2])))) AS f, list_sort(list(DISTINCT strftime(l_shipdate, '%Y-%m'))) AS d FROM lineitem GROUP BY 1) SELECT k, n_ids, best_position, array_to_string(f, ',') AS found_by, CASE WHEN len(d) > 1 THEN array_to_string(d, ',') END AS dates FROM x")
def merged_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: copies as one: the union of what found them, the best place, the dates that differ."""
    n = F.col("l_linenumber")
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("id"), F.array(n % 3, n % 2).alias("f"), F.col("l_suppkey").alias("p"), F.date_format("l_shipdate", "yyyy-MM").alias("date"))
    out = merging.copies_merged(rows, "k", "id", "f", "p", "date")
    return out.select("k", "n_ids", "best_position", F.array_join("formulations", ",").alias("found_by"), F.array_join("dates_differ", ",").alias("dates"))


@register("WITH g AS (SELECT l_partkey AS k, 'p' || l_suppkey % 40 AS p, min(l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber % 4 <> 0 GROUP BY 1, 2), s AS (SELECT k, string_agg(p, ',' ORDER BY n, p) AS processes FROM g GROUP BY k) SELECT p_partkey AS k, coalesce(processes, '') AS processes FROM part LEFT JOIN s ON s.k = p_partkey")
def theme_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes with the processes that lead them, without those that were withdrawn."""
    n = F.col("l_linenumber")
    processes = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.concat(F.lit(" p"), (F.col("l_suppkey") % 40).cast("string")).alias("p"), F.when(F.col("l_returnflag") == "R", "S").otherwise("N").alias("leads"), F.when(n % 4 == 0, "x").otherwise(" ").alias("withdrawn"), (F.col("l_orderkey") * 10 + n).alias("n"))
    themes = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    out = merging.theme_processes(themes, processes, "k", "p", "leads", "withdrawn", "n")
    return out.select("k", F.coalesce(F.array_join("processes", ","), F.lit("")).alias("processes"))


@register("WITH m AS (SELECT c_custkey AS k, unnest(range(1, 25)) AS n FROM customer) SELECT c_custkey AS k, 1 AS place, 'tjgo' AS court FROM customer UNION ALL SELECT k, CAST(CASE WHEN n = 3 THEN CASE WHEN k % 2 = 0 THEN 25 ELSE 2 END WHEN k % 2 = 0 THEN 1 + n - (n > 3)::INT ELSE 2 + n - (n > 3)::INT END AS INTEGER), 'trt' || n FROM m")
def court_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group of courts stands for its members, those named staying where they are; none twice."""
    k, lists = F.col("c_custkey"), lambda *c: F.array(*map(F.lit, c))
    rows = t(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 2 == 0, lists("tjgo", "trt", "trt3", "TRT")).otherwise(lists("tjgo", "trt3", "trt", "trt3")).alias("courts"))
    return merging.court_lists(rows, "k", "courts")


@register("WITH c AS (SELECT user_id AS k, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2) SELECT k, '{' || string_agg('\"' || t || '\":' || n, ',' ORDER BY t) || '}' AS counts FROM c GROUP BY k")
def reason_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason came, as a map."""
    return fusion.reason_counts(t(spark, sf_dir, "events"), F.col("user_id").alias("k"), "event_type").select("k", F.to_json("counts").alias("counts"))


@register("WITH e AS (SELECT user_id % 60 AS f, CAST(user_id % 4 AS VARCHAR) AS c, event_type FROM events), g AS (SELECT f, count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM e GROUP BY f) SELECT f AS formulation FROM g WHERE hits = 0 UNION ALL SELECT 60")
def barren_in_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulations that every task answered and that found nothing, one at least."""
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("formulation"), (F.col("user_id") % 4).cast("string").alias("court"), "event_type")
    tasks = e.select("formulation", "court").distinct().unionByName(spark.createDataFrame([(60, "0")], "formulation long, court string"))
    return fusion.barren(tasks, tasks.withColumn("status", F.lit("answered")), e.where("event_type = 'purchase'"))


_YEARS = (1993, 1995, 1996, 1997)
_RULES = ", ".join(f"({y})" for y in _YEARS)


@register(f"""WITH v AS (SELECT 'year>' || y AS rule, l_orderkey % 2 AS half, year(l_shipdate) <= 1995 AND l_orderkey % 3 = 0 AS relevant FROM lineitem, (VALUES {_RULES}) r(y) WHERE year(l_shipdate) > y), c AS (SELECT rule, half, count(*) AS removed, count(*) FILTER (WHERE relevant) AS lost FROM v GROUP BY 1, 2)
SELECT c.half AS tried_on, 1 - c.half AS fitted_on, rule AS chosen, removed, lost, (SELECT removed FROM c d WHERE d.half <> c.half AND d.rule = c.rule) AS removed_there FROM c WHERE rule = 'year>1995'""")
def safe_year_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best exclusion that loses nothing in one half, tried on the other; one stands."""
    year = F.year("l_shipdate")
    rows = t(spark, sf_dir, "lineitem").select(year.alias("y"), (F.col("l_orderkey") % 2).alias("half"), ((year <= 1995) & (F.col("l_orderkey") % 3 == 0)).alias("relevant"))
    votes = rows.withColumn("x", F.explode(F.array(*map(F.lit, _YEARS)))).where("y > x").select(F.concat(F.lit("year>"), F.col("x").cast("string")).alias("rule"), "half", "relevant")
    return merging.safe_rules(votes, "rule", "half", "relevant")


@register("SELECT o_orderkey AS page, CAST(o_orderkey * 2 + n AS VARCHAR) AS id, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '-11.2020.4.04.7000' AS number, 'Apelação Cível' AS class, DATE '2024-03-05' AS day, CASE WHEN n = 1 THEN 'Ana (relator para o acórdão: Rui)' ELSE 'Ana' END AS rapporteur, CASE WHEN n = 0 THEN 'Coisa & causa ' || o_orderkey END AS summary, CAST(1 - n AS BIGINT) AS n_repeated FROM orders, range(2) r(n)")
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a federal source's page, strictly read; a card that stands twice is one."""
    k = F.col("o_orderkey")
    text = lambda c: c if hasattr(c, "alias") else F.lit(c)
    field = lambda name, value: F.concat(F.lit(f'<div class="row"><div class="col resLabel">{name}</div><div class="col resValue">'), text(value), F.lit("</div></div>"))

    def card(n: int, *more):
        id_ = (k * 2 + n).cast("string")
        number = F.concat(F.lpad(k.cast("string"), 7, "0"), F.lit("-11.2020.4.04.7000/TRF4 AC - Apela&ccedil;&atilde;o Cível"))
        summary = F.concat(F.lit("<p>Coisa &amp; causa "), k.cast("string"), F.lit("</p>")) if n == 0 else F.lit("")
        head = F.concat(F.lit('<div class="card mb-3 resultadoItem" id="resultado'), id_, F.lit('"><a href="#" data-link="https://www.trf4.jus.br/x?a=1&amp;id_jurisprudencia='), id_, F.lit('">x</a>'))
        return F.concat(head, field("PROCESSO", number), field("UF", "PR"), field("DATA DO JULGAMENTO", "05/03/2024"), field("DATA DA PUBLICAÇÃO", "31/02/2024"), field("RELATORA", "Ana"), *more, field("EMENTA", summary), F.lit("</div>"))

    html = F.concat(F.lit('<input type="hidden" id="hdnTotalResultado" value="3"><!-- <div class="resultadoItem"> -->'), card(0), card(1, field("RELATOR PARA ACÓRDÃO", "Rui")), card(0), F.lit("<div>fim</div>"))
    rows = spread(t(spark, sf_dir, "orders")).select(k.alias("page"), html.alias("html"))
    out = answers.cards(rows, "page", "html", "TRF4", "trf4\\.jus\\.br")
    return out.select("page", "id", "number", "class", "day", "rapporteur", "summary", "n_repeated")
