"""Citations, references and sources as queries, over the driver's tables and small literal inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import spread
from ..functions.text import cleaned
from ..operators import citation, classify, references
from ..sources import answers, readers

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


_SQUEEZED = r"trim(regexp_replace(nfc_normalize(text), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"


@register(rf"""WITH b AS (SELECT item_id, {_SQUEEZED} AS c FROM benchmark), d AS (SELECT doc_id, {_SQUEEZED} AS t FROM documents),
m AS MATERIALIZED (SELECT item_id, doc_id, c, t FROM b JOIN d ON contains(t, c))
SELECT item_id, doc_id FROM m WHERE regexp_matches(t, '(?:^|[^\p{{L}}\p{{N}}])' || regexp_escape(c) || '(?:[^\p{{L}}\p{{N}}]|$)')""")
def literal_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in a text word for word; candidates by shared runs of words."""
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return citation.verdicts(b, spread(d).select("doc_id", "text"), literal_only=True).where("verdict = 'literal'").select("item_id", "doc_id")


@register()
def quotation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict of every passage; near passages by the longest run of words in order (no SQL twin)."""
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return citation.verdicts(b, spread(d).select("doc_id", "text"))


_TEXTS = [
    (1, "LEG:EST LEI:000412 ANO:1997\n***** LX-97 NORMA\nART:00031 ART:00040 INC:00012 ART:00058 PAR:00009"),
    (2, "LEG:EST ENU:****** ANO:****\n***** ENU(XY) ENUNCIADOS\nSUM:000123"),
    (3, "LEG:EST CTA:****** ANO:1971\nART:00017 INC:00021 INC:00022 LET:F PAR:UNICO (obs. (feita)  hoje)"),
    (4, "out of form"),
]


@register("""SELECT * FROM (VALUES (1, 'LEI 412', '31', '', 1), (1, 'LEI 412', '40', '12', 1), (1, 'LEI 412', '58', '9', 1), (2, 'ENU ENU(XY)', NULL, '', 1), (3, 'CTA', '17', '21', 1), (3, 'CTA', '17', '22.F', 1), (3, 'CTA', '17', 'único', 1)) v(id, law, article, detail, n)""")
def legal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged reference texts to devices."""
    rows = spark.createDataFrame([(i, [t]) for i, t in _TEXTS], "id int, texts array<string>")
    index = references.device_index(rows, "id", "texts")
    return index.select(F.explode("keys").alias("id"), "law", "article", "detail", F.lit(1).alias("n"))


@register("SELECT * FROM (VALUES ('art. 61, § 4º, III, c', 'art61_par4_inc3_ali3'), ('Artigo 2.417, caput', 'art2417_cpt'), ('art. 9º, XLII', 'art9_cpt_inc42'), ('art. 33-B, parágrafo único', 'art33-B_par1u'), ('art 7, iiii', NULL), ('nothing', NULL)) v(text, key)")
def device_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices as people write them."""
    rows = spark.createDataFrame([(x,) for x in ("art. 61, § 4º, III, c", "Artigo 2.417, caput", "art. 9º, XLII", "art. 33-B, parágrafo único", "art 7, iiii", "nothing")], "text string")
    return rows.select("text", references.device_key(F.col("text")).alias("key"))


_ANSWERS = [(1, '{"reranked_results":[{"id":"b","score":0.9,"original_bucket":"juris"},{"id":"t","original_bucket":"temas"},{"id":"a","orgao":"new","original_bucket":"results"}],"results":[{"id":"a","ementa":"A","orgao":"old"},{"id":"c","ementa":"C"}],"juris":[{"id":"b","ementa":"B"}]}')]


@register("SELECT * FROM (VALUES (1, 0, 'b', 'B', NULL, 0.9::DOUBLE), (1, 1, 'a', 'A', 'new', NULL), (1, 2, 'c', 'C', NULL, NULL)) v(page, position, id, ementa, orgao, score)")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of search answers, order from the reranked list."""
    pages = spark.createDataFrame(_ANSWERS, "page int, body string")
    return readers.search_answers(pages, "page", "body").select("page", "position", "id", "ementa", "orgao", "score")


_TABLE = "<table><tr><th>Tema</th><th>Título</th></tr><tr><td>1</td><td>Primeiro &amp; único</td></tr><tr><td> 2 </td><td><b>Segundo</b></td></tr></table>"


@register("SELECT * FROM (VALUES (1, 1, '1', 'Primeiro & único'), (1, 2, '2', 'Segundo')) v(page, \"row\", tema, titulo)")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table inside a page."""
    pages = spark.createDataFrame([(1, _TABLE)], "page int, html string")
    rows = readers.html_rows(pages, "page", "html", ["Tema", "Título"])
    return rows.select("page", "row", F.col("Tema").alias("tema"), F.col("Título").alias("titulo"))


@register("SELECT page_id, host, secure, extract_ok FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, starts_with(url, 'https://') AS secure, html LIKE '%</html>%' AS extract_ok FROM pages)")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, scheme and whether a page is whole."""
    u = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract(u, "^[a-z]+://([^/?#:]+)", 1)).alias("host"), u.startswith("https://").alias("secure"), F.col("html").contains("</html>").alias("extract_ok"))


@register("SELECT * FROM (VALUES (2024, 'https://x/acordao-completo-2024.csv', 489.97::DOUBLE), (2023, NULL, 1536.0::DOUBLE), (2022, NULL, NULL)) v(year, url, mb)")
def yearly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, addresses and sizes of a list of files."""
    lines = spark.createDataFrame([("05/10/2026",), ("A|2024|489,97 MB|https://x/acordao-completo-2024.csv",), ("A|2023|1.5 GB|acordao-completo-2023.csv",), ("A|2023|9 MB|acordao-completo-2023.csv",), ("acordao-completo-2022.csv",)], "value string").coalesce(1)
    return readers.file_list(lines)


@register("SELECT * FROM (VALUES (1, 'blocked'), (2, 'challenge'), (3, NULL), (4, 'challenge')) v(id, state)")
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Challenge and block pages are no content."""
    pages = [(1, "<html><body>Página bloqueada</body></html>"), (2, "<head><title>Just a moment...</title></head><body>x</body>"), (3, "<body>captcha in a normal text</body>"), (4, "<body>Digite o c&oacute;digo Verificação de Segurança</body>")]
    return spark.createDataFrame(pages, "id int, html string").select("id", readers.blocked(F.col("html")).alias("state"))


@register()
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside text without addresses, long numbers and codes, bounded (no SQL twin: codes need look-around; tested on known texts)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", cleaned(F.col("text")).alias("cleaned"))


@register(r"SELECT o_orderkey AS id, 'Proc. [nº de processo omitido] fim' AS masked FROM orders")
def masked_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process numbers out of reports."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Proc. "), F.when(k % 2 == 0, F.concat(F.lpad(k.cast("string"), 7, "0"), F.lit("-11.2020.8.27.0001"))).otherwise(F.lit("1.234.567/SP")), F.lit(" fim"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), classify.masked(text).alias("masked"))


_LABOUR = [(1, '{"quantidadeTotal":3,"documentos":[{"idDocumentoAcordao":"a","tribunal":"TRT1","ementa":"<p>Um&amp;</p>","possuiEmenta":"S","dataJulgamento":"05/03/2024"},{"idDocumentoAcordao":"b","tribunal":"TRT1","ementa":"x","possuiEmenta":"N","dataJulgamento":"31/02/2024"}]}'), (2, '{"quantidadeTotal":4,"documentos":[{"idDocumentoAcordao":"a","tribunal":"TRT1","ementa":"other","possuiEmenta":"S"}]}')]


@register("SELECT * FROM (VALUES ('trt1', 'a', 'Um&', DATE '2024-03-05', 1, 0, true), ('trt1', 'b', NULL, NULL, 1, 1, true)) v(court, id, summary, day, page, position, total_drifts)")
def labour_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a source, without repeats, and whether their totals drift."""
    return answers.labour_decisions(spark.createDataFrame(_LABOUR, "page int, body string"), "page", "body").select("court", "id", "summary", "day", "page", "position", "total_drifts")


_OFFICIAL = [('{"hits":{"value":3},"registros":[{"uuid":"u1","base":"acordaos","processo":"1","ementa":"E","dataJulgamento":"2024-03-05T01:00:00.000Z"},{"uuid":"u2","base":"acordaos","ementa":"S","segredoJustica":true},{"uuid":"u3","base":"outra"}]}',)]


@register("SELECT * FROM (VALUES ('u1', 'E', '2024-03-04', 1::BIGINT), ('u2', NULL, NULL, 1::BIGINT)) v(uuid, summary, day, n_other)")
def official_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An official search, its decisions and the count of other records; secrecy means no text."""
    return answers.official_decisions(spark.createDataFrame(_OFFICIAL, "body string"), "body").select("uuid", "summary", "day", "n_other")


_REGISTERS = [('{"timed_out":false,"_shards":{"failed":0},"hits":{"total":{"value":3},"hits":[{"_source":{"numeroProcesso":"123","grau":"G2","movimentos":[{"codigo":237,"nome":"Provimento","dataHora":"20240305101112"},{"codigo":237,"nome":"Provimento","dataHora":"20240305101112"},{"codigo":581,"nome":"Documento","dataHora":"2024-03-04T10:00:00.000Z","complementosTabelados":[{"nome":"Acórdão"}]},{"codigo":581,"nome":"Documento","dataHora":"x","complementosTabelados":[{"nome":"Certidão"}]},{"codigo":1,"nome":"Outro"}]}},{"_source":{"numeroProcesso":"123","grau":"G1"}},{"_source":{"numeroProcesso":"9","grau":"G2"}}]}}',)]


@register("SELECT * FROM (VALUES (0, 581, TIMESTAMP '2024-03-04 10:00:00', 1, 1::BIGINT, 1::BIGINT), (0, 237, TIMESTAMP '2024-03-05 10:11:12', 2, 1::BIGINT, 1::BIGINT)) v(n, code, \"at\", place, n_other_number, n_first_degree)")
def register_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers of a process and the results among their movements, in order of time."""
    rows = answers.registers(spark.createDataFrame(_REGISTERS, "body string"), "body", "1-2.3")
    found = answers.results(rows, "n", "movements", spark.createDataFrame([(237,), (238,)], "code int"))
    return found.join(rows.select("n", "n_other_number", "n_first_degree"), "n").select("n", "code", F.col("at").cast("timestamp_ntz").alias("at"), "place", "n_other_number", "n_first_degree")


@register("SELECT * FROM (VALUES (0, 2, '2024-01-01', 'Intimação'), (1, 2, '2024-01-02', NULL)) v(n, total, day, kind)")
def journal_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with allowed fields only."""
    body = '{"count":2,"items":[{"data_disponibilizacao":"2024-01-01","tipoComunicacao":"Intimação","destinatarios":[{"nome":"x"}]},{"data_disponibilizacao":"2024-01-02"}]}'
    return answers.notices(spark.createDataFrame([(body,)], "body string"), "body").select("n", "total", "day", "kind")


@register("SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'link_shape' WHEN NOT contains(html, '<article>') THEN 'no_article' WHEN NOT contains(html, '</html>') THEN 'cut' WHEN length(html) < 1500 THEN 'too_short' END AS reason FROM pages")
def guarded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of guards, the first that fails being the reason; no text without all."""
    u, h = F.col("url"), F.col("html")
    out = answers.guarded(h, [("link_shape", u.startswith("https://")), ("no_article", h.contains("<article>")), ("cut", h.contains("</html>"))], 1500)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", out["reason"].alias("reason"))
