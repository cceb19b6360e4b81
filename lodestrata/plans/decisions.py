"""Queries over the parts of decisions: sections, sentences, quotes, summaries, classes, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions
from ..functions.staging import spread
from ..operators import laws

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


def _case(key: Column, values: list[str]) -> Column:
    out = F.lit(values[-1])
    for n in range(len(values) - 2, -1, -1):
        out = F.when(key % len(values) == n, values[n]).otherwise(out)
    return out


_TITLES = ["RELATÓRIO", "Voto", "V O T O  V E N C I D O :", "CERTIDÃO DE JULGAMENTO", "VOTO VENCIDO DO RELATOR", "Voto do Relator"]


@register(f"""WITH d AS (SELECT doc_id, 'EMENTA' || chr(10) || text || chr(10) || (CASE doc_id % 6 {' '.join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(_TITLES))} END) || chr(10) || text || chr(10) || ' ACÓRDÃO ' || chr(10) || 'fim' AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS n FROM d),
s AS (SELECT doc_id, line, trim(line) AS title, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
k AS (SELECT doc_id, CAST(start AS BIGINT) AS start, title, CASE WHEN title = 'EMENTA' THEN 'ementa' WHEN title = 'ACÓRDÃO' THEN 'acórdão' WHEN title = 'RELATÓRIO' THEN 'relatório' WHEN title = 'Voto' THEN 'voto' WHEN title IN ('V O T O  V E N C I D O :', 'VOTO VENCIDO DO RELATOR') THEN 'voto vencido' WHEN title = 'CERTIDÃO DE JULGAMENTO' THEN 'certidão' END AS section FROM s WHERE length(line) <= 80)
SELECT doc_id, start, section, title FROM k WHERE section IS NOT NULL AND NOT (section = 'acórdão' AND doc_id % 6 IN (0, 2, 4))""")
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of sections and where they stand; a decision's title inside a report or a dissent is none."""
    middle = _case(F.col("doc_id"), _TITLES)
    text = F.concat(F.lit("EMENTA\n"), F.col("text"), F.lit("\n"), middle, F.lit("\n"), F.col("text"), F.lit("\n ACÓRDÃO \nfim"))
    return decisions.section_titles(t(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.alias("text")), "doc_id", "text")


_LIST = ", ".join(f"'{w}'" for w in decisions.SHORT_FORMS)


@register(rf"""WITH d AS (SELECT doc_id, 'Conforme o art. 37. O dano. 2. A culpa de Rel. Min. Silva! ' || text AS x FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, unnest(regexp_extract_all(x, '\S+')) AS w, unnest(regexp_extract_all(x || ' ', '\S+(\s+)', 1)) AS g, unnest(range(len(regexp_extract_all(x, '\S+')))) AS n FROM d),
c AS (SELECT doc_id, w, g, n, lower(regexp_replace(w, '^[(\x22“«\[]+', '')) AS core, lead(w) OVER o AS nw, lead(g) OVER o AS ng, lag(lower(regexp_replace(w, '^[(\x22“«\[]+', ''))) OVER o AS pw FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT doc_id, n, w, (nw IS NULL OR contains(g, chr(10)) OR (regexp_matches(w, '[.!?]$') AND NOT (left(core, -1) IN ({_LIST}) OR regexp_full_match(left(core, -1), '\p{{L}}'))
  AND (NOT regexp_full_match(left(core, -1), '\d{{1,9}}') OR coalesce(ends_with(pw, '.') AND (left(pw, -1) IN ({_LIST}) OR regexp_full_match(left(pw, -1), '\p{{L}}')), false))
  AND (regexp_matches(nw, '^\p{{Lu}}') OR regexp_full_match(nw, '\d{{1,9}}[.)]')))) AS last FROM c)
SELECT doc_id, count(*) FILTER (WHERE last) AS n_sentences, count(*) AS n_words FROM b GROUP BY doc_id""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, where points of short forms and item numbers end none."""
    text = F.concat(F.lit("Conforme o art. 37. O dano. 2. A culpa de Rel. Min. Silva! "), F.col("text"))
    s = t(spark, sf_dir, "documents").where("text is not null").select("doc_id", decisions.sentences(text).alias("s"))
    words = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.size(F.split(x, r"\s+")))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), words.alias("n_words"))


@register("SELECT doc_id, doc_id % 5 IN (0, 3, 4) AS quoted FROM documents")
def quoted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a passage stands inside open quotes: open, closed, none, a straight mark after a digit, one inside it."""
    k, text = F.col("doc_id"), F.coalesce(F.regexp_replace("text", "[\"“”«»]", ""), F.lit(""))
    head = _case(k, ["Disse o autor: “", "Disse o autor: “x” ", "Disse o autor: ", 'A medida "12" de x ', "Disse o autor: "])
    tail = F.when(k % 5 == 4, " e «fim»").otherwise(" e fim")
    rows = t(spark, sf_dir, "documents").select(k, F.concat(head, text, tail).alias("x"), F.length(head).alias("a"), (F.length(head) + F.length(text) + 6).alias("b"))
    return rows.select("doc_id", decisions.quoted(F.col("x"), F.col("a"), F.col("b")).alias("quoted"))


_HEAD = "PODER JUDICIÁRIO Tribunal Processo: APELAÇÃO n. 1 APELANTE: Fulano APELADO(A): Beltrano "


@register("""WITH d AS (SELECT o_orderkey AS k, 'APELAÇÃO. ' || o_orderpriority || ' ' || o_orderstatus || '.' AS body FROM orders)
SELECT k, CASE k % 7 WHEN 0 THEN 'EMENTA ' || body WHEN 1 THEN ' ' || body WHEN 2 THEN body WHEN 3 THEN 'Ementa: ' || body WHEN 4 THEN 'EMENTA ' || body || ' VOTO: nega' WHEN 5 THEN 'Apelante: A EMENTA ' || body ELSE 'EMENTA ' || body END AS summary,
CASE k % 7 WHEN 0 THEN 'header' WHEN 2 THEN 'header_and_close' WHEN 3 THEN 'whole_decision' WHEN 4 THEN 'start_only' WHEN 6 THEN 'start_only' END AS note FROM d""")
def summaries_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary without the head of the process and the rest of the decision, or only its start."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("APELAÇÃO. "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"), F.lit("."))
    court = _case(k, ["tjpe", "tjmt", "tjba", "tjba", "tjpb", "tjsp", "tjba"])
    before = _case(k, ["Recorrente(s): Fulano ", " ", _HEAD + "ACORDÃO ", "Apelante : Fulano ", "Agravada: Fulana ", "Apelante: A EMENTA ", "Apelante: A "])
    mark = _case(k, ["EMENTA ", "", "", "Ementa: ", "EMENTA ", "", "EMENTA "])
    after = _case(k, ["", "", " Vistos, relatados e discutidos estes autos. Acordam os juízes. ( Classe: Apelação)", " RELATÓRIO Trata-se de recurso. VOTO: nega", " VOTO: nega", "", ""])
    rows = spread(t(spark, sf_dir, "orders")).select(k.alias("k"), decisions.summary_alone(court, F.concat(before, mark, body, after)).alias("s"))
    return rows.select("k", "s.summary", "s.note")


_CLASSES = ["3ª Turma Cível", "Apelação Cível", "Agravo Interno em Apelação Cível", "Recurso Especial", "Apelação Cível", "Mandado de Segurança", "Agravo de Instrumento"]
_SUMMARIES = ["APELAÇÃO.", "EMENTA: AGRAVO DE INSTRUMENTO. Direito civil.", "APELAÇÃO CÍVEL. Agint. Direito civil.", "Direito civil. (Apelação Cível - 0000001-11.2020.8.09.0001, Rel. X)", "Precedente: Agravo Interno. Direito civil.", "RECURSO ESPECIAL. Direito.", "RECURSO DE APELAÇÃO CÍVEL – Direito."]


@register("SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'body' WHEN 1 THEN 'summary' WHEN 3 THEN 'summary' WHEN 6 THEN 'summary' END AS kind, CASE o_orderkey % 7 WHEN 1 THEN 'agravo de instrumento' WHEN 3 THEN 'apelacao civel' WHEN 6 THEN 'apelacao civel' END AS named FROM orders")
def class_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that the summary speaks against, or that name a judging body."""
    k = F.col("o_orderkey")
    doubt = decisions.class_doubt(_case(k, _CLASSES), _case(k, _SUMMARIES), F.lit("0000001-11.2020.8.09.0001"))
    return t(spark, sf_dir, "orders").select(k.alias("k"), doubt.alias("d")).select("k", "d.kind", "d.named")


@register("SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'direito civil, pedido ' || o_orderkey || ', OAB omitida' WHEN 5 THEN 'ligue [telefone retirado] e CEP [CEP retirado]' END AS excerpt FROM orders")
def notice_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of notices, without people and their numbers; none on any doubt."""
    k, number = F.col("o_orderkey"), "0000001-11.2020.8.09.0001"
    body = F.concat(F.lit("Apelante: Fulano\ndireito civil, pedido "), k.cast("string"), F.lit(", OAB omitida\n"))
    named = F.lit("direito civil de Maria Souza\n")
    phone = F.lit("ligue (62) 99999-1234 e CEP 74.000-000\n")
    inside = F.when(k % 6 == 1, named).when(k % 6 == 5, phone).otherwise(body)
    other = F.when(k % 6 == 2, "Outro 0000002-11.2020.8.09.0001\n").when(k % 6 == 3, "EMENTA: outra\n").otherwise("")
    text = F.concat(F.lit(f"Processo {number}\n"), other, F.lit("EMENTA: "), inside, F.lit("ACÓRDÃO: nega"))
    names = F.when(k % 6 == 4, F.array(F.lit("Direito Civil"))).otherwise(F.array(F.lit("Sicrano")))
    return t(spark, sf_dir, "orders").select(k.alias("k"), decisions.notice_excerpt(F.lit("Acórdão"), text, F.lit(number), names).alias("excerpt"))


@register("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN date_trunc('minute', ts) END AS updated FROM events")
def updated_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: instants with the month's name; another form is none."""
    at = F.col("ts").cast("timestamp")
    month = F.element_at(F.array(*map(F.lit, decisions.MONTHS)), F.month(at))
    text = F.concat(F.when(F.col("event_id") % 9 == 0, "Atualizado em ").otherwise("Última Atualização "), month, F.lit(" "), F.dayofmonth(at).cast("string"), F.lit(", "), F.date_format(at, "yyyy, HH:mm"), F.lit(" (UTC)"))
    return t(spark, sf_dir, "events").select("event_id", decisions.updated_at(text).cast("timestamp_ntz").alias("updated"))


@register("SELECT o_custkey AS k, count(*) AS came, CASE WHEN count(*) >= 12 THEN 'may_have_more' WHEN o_custkey % 2 = 0 THEN 'few_per_search' ELSE 'exhausted' END AS state FROM orders GROUP BY o_custkey")
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the number of records that came says of a base whose total is unknown."""
    came = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("came"))
    return came.select("k", "came", decisions.coverage_state(F.col("came"), F.lit(12), F.when(F.col("k") % 2 == 0, 10).otherwise(100)).alias("state"))


@register("""SELECT c_custkey AS k, CAST(length('{"name":"","n":}') + length(c_name) + length(CAST(c_custkey AS VARCHAR)) AS INTEGER) AS cost FROM customer""")
def json_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row takes as JSON."""
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), decisions.json_cost(F.col("c_name").alias("name"), F.col("c_custkey").alias("n")).alias("cost"))


_LAW = ["Menu", "LEI DAS COISAS", "TÍTULO I", "Das Coisas", "Art. {k}. Coisa.", "I - a primeira;", "a) uma parte;", "Pena - perder.", "§ 3º. Outro:", "“Art citado", "II - dentro”", "Solto", "Parágrafo único. Só.", "Arts. 5 a 7. Revogados.", "Brasília, 1 de maio de 1990; 169º da Independência e 102º da República.", "Nome"]
_DEVICES = [("art{k}_cpt", "Art. {k}.", "Coisa."), ("art{k}_cpt_inc1", "I -", "a primeira;"), ("art{k}_cpt_inc1_ali1", "a)", "uma parte;"), ("art{k}_cpt", None, "Pena - perder."), ("art{k}_par3", "§ 3º.", "Outro:"), ("art{k}_par3", None, "“Art citado"), ("art{k}_par3", None, "II - dentro”"), ("art{k}_par1u", "Parágrafo único.", "Só."), ("art5-7", "Arts. 5 a 7.", "Revogados.")]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in _DEVICES)


@register(f"SELECT o_orderkey AS law, replace(d, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS device, replace(l, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS label, t AS text FROM orders, (VALUES {_VALUES}) v(d, l, t)")
def law_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of laws as lines, each with the device that owns it."""
    page = F.lit("<html><body>" + "".join(f"<p>{x}</p>" for x in _LAW) + "</body></html>")
    html = F.replace(page, F.lit("{k}"), F.col("o_orderkey").cast("string"))
    rows = spread(t(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("law"), laws.law_paragraphs(html, F.lit("LEI DAS COISAS")).alias("p"))
    return laws.law_lines(rows, "law", "p").select("law", "device", "label", "text")
