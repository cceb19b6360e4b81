"""Parts of decisions on known texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import decisions as d


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("Um. Dois! Três? Quatro", ["Um.", "Dois!", "Três?", "Quatro"]),
        ("Rel. Min. Fulano. O art. 37 da lei.", ["Rel. Min. Fulano.", "O art. 37 da lei."]),
        ("Pelo art. 37. O dano", ["Pelo art. 37.", "O dano"]),
        ("Nega. 2. A culpa", ["Nega.", "2. A culpa"]),
        ("uma linha\nsem ponto\n\n outra", ["uma linha", "sem ponto", "outra"]),
        ("Fim. não começa", ["Fim. não começa"]),
        ("", []),
        (None, None),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, d.sentences(F.col("t")), t=F.lit(text).cast("string")) == want


def test_sentences_at_is_a_slice(spark):
    text = "Um dois. Três quatro, Rel. Min. Xavier. Cinco\nseis sete."
    for first, last, want in [("Um", "Um", "Um dois."), ("Três", "Três", "Três quatro, Rel. Min. Xavier."), ("dois", "Três", "Um dois. Três quatro, Rel. Min. Xavier."), ("Cinco", "Cinco", "Cinco"), ("sete", "sete", "seis sete.")]:
        a, b = text.index(first), text.index(last) + len(last)
        assert one(spark, d.sentences_at(F.col("t"), F.lit(a), F.lit(b)), t=text) == want


def _open_by_force(text, a, b):
    """Mark by mark, as the rule reads."""
    opened, found = False, False
    for i, c in enumerate(text[:b]):
        opens = c in "“«" or (c == '"' and (i == 0 or text[i - 1].isspace() or text[i - 1] in "([{—–-"))
        closes = not opens and (c in "”»" or (c == '"' and not text[i - 1].isdigit()))
        if i < a:
            opened = opens or (opened and not closes)
        else:
            found = found or opens
    return opened or found


def test_quoted_against_marks(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice('ab1 "“”«»(-') for _ in range(14)), a, a + rng.randint(0, 6)) for a in range(9) for _ in range(60)]
    got = spark.createDataFrame(rows, "t string, a int, b int").select("t", "a", "b", d.quoted(F.col("t"), F.col("a"), F.col("b")).alias("q")).collect()
    assert [r.q for r in got] == [_open_by_force(r.t, r.a, r.b) for r in got]


def test_section_titles(spark):
    text = "EMENTA\nR E L A T Ó R I O\nACÓRDÃO\nVOTO-VISTA:\n ACÓRDÃO\nVoto do relator\nEmenta longa\n" + "VOTO" * 30 + "\nCERTIDÃO"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x")], "k int, t string")
    got = [tuple(r) for r in d.section_titles(rows, "k", "t").orderBy("start").collect()]
    assert [(r[2], r[3]) for r in got] == [("ementa", "EMENTA"), ("relatório", "R E L A T Ó R I O"), ("voto-vista", "VOTO-VISTA:"), ("acórdão", "ACÓRDÃO"), ("certidão", "CERTIDÃO")]
    assert all(text[r[1] :].lstrip().startswith(r[3]) for r in got)


@pytest.mark.parametrize(
    "court, field, summary, note",
    [
        ("tjpe", "Recorrente: A EMENTA Civil. Dano.", "EMENTA Civil. Dano.", "header"),
        ("tjpe", "Civil. EMENTA no meio.", "Civil. EMENTA no meio.", None),
        ("tjpe", "EMENTA Recorrente: A Civil.", "EMENTA Recorrente: A Civil.", None),
        ("tjsp", "Recorrente: A EMENTA Civil.", "Recorrente: A EMENTA Civil.", None),
        ("tjmt", "Civil. VOTO: nego", "Civil. VOTO: nego", "start_only"),
        ("tjmt", "Civil. VOTO VENCIDO na origem.", "Civil. VOTO VENCIDO na origem.", None),
        ("tjba", "EMENTA: PODER JUDICIÁRIO Processo: 1 APELANTE: A APELADO: B ACORDÃO Civil. ACÓRDÃO Vistos estes", "Civil.", "header_and_close"),
        ("tjba", "PODER JUDICIÁRIO Processo: 1 APELANTE: A ACORDÃO Civil.", "PODER JUDICIÁRIO Processo: 1 APELANTE: A ACORDÃO Civil.", None),
        ("tjba", "Apelado: A Ementa: Civil. Vistos, relatados e discutidos os presentes autos", "Ementa: Civil. Vistos, relatados e discutidos os presentes autos", "start_only"),
        ("tjpb", "Apelado: A " + "x " * 900 + "EMENTA Civil", "Apelado: A " + "x " * 900 + "EMENTA Civil", None),
        (None, "EMENTA Civil", "EMENTA Civil", None),
        ("tjpb", None, None, None),
        ("tjba", "", "", None),
    ],
)
def test_summary_alone(spark, court, field, summary, note):
    got = one(spark, d.summary_alone(F.col("c"), F.col("f")), c=F.lit(court).cast("string"), f=F.lit(field).cast("string"))
    assert (got.summary, got.note) == (summary, note)


def test_long_start_ends_between_words(spark):
    got = one(spark, d.summary_alone(F.lit("tjmt"), F.col("f")), f="palavra " * 200 + "VOTO: nego")
    assert got.note == "start_only" and len(got.summary) <= 600 and set(got.summary.split()) == {"palavra"}


N = "0000001-11.2020.8.09.0001"


@pytest.mark.parametrize(
    "class_, summary, want",
    [
        ("2ª Câmara Cível", "x", ("body", None)),
        ("Apelação", "APELAÇÃO CRIMINAL. x", (None, None)),
        ("Apelação Cível", "RECURSO INOMINADO. x", ("summary", "recurso inominado")),
        ("Apelação Cível", "Civil. RECURSO INOMINADO de origem. x", (None, None)),
        ("Apelação Cível", "Civil (RECURSO INOMINADO. x)", (None, None)),
        ("Apelação Cível", f"Civil (TJ-GO, Recurso Inominado {N})", ("summary", "recurso inominado")),
        ("Apelação Cível", "Civil (Recurso Inominado 9999999-11.2020.8.09.0001)", (None, None)),
        ("Agravo", "AGRAVO INTERNO. x", (None, None)),
        ("Ação Penal", "APELAÇÃO CRIMINAL. x", (None, None)),
        ("Recurso Especial", "REsp. APELAÇÃO. x", (None, None)),
        (None, "APELAÇÃO.", (None, None)),
        ("Apelação", None, (None, None)),
    ],
)
def test_class_doubt(spark, class_, summary, want):
    got = one(spark, d.class_doubt(F.col("c"), F.col("s"), F.lit(N)), c=F.lit(class_).cast("string"), s=F.lit(summary).cast("string"))
    assert (got.kind, got.named) == want


def _notice(inside, before="", after=""):
    return f"Processo {N}\n{before}EMENTA: {inside}\nACÓRDÃO: nega{after}"


@pytest.mark.parametrize(
    "text, names, want",
    [
        (_notice("direito civil."), [], "direito civil."),
        (_notice("direito.\nRelator: Fulano\nnega"), [], "direito. nega"),
        (_notice("cpf 123.456.789-00 oab/GO 12.345 cep 74.000-000"), [], "cpf [número retirado] [OAB retirada] cep [CEP retirado]"),
        (_notice("de Maria Souza"), [], None),
        (_notice("de maria"), ["Maria"], None),
        (_notice("civil", after=" PAUTA"), [], None),
        (_notice("civil", before="9999999-11.2020.8.09.0001\n"), [], None),
        (_notice("civil “x”"), [], None),
        (None, [], None),
        ("", [], None),
    ],
)
def test_notice(spark, text, names, want):
    array = F.array(*map(F.lit, names)).cast("array<string>")
    assert one(spark, d.notice_excerpt(F.lit("Acórdão"), F.col("t"), F.lit(N), array), t=F.lit(text).cast("string")) == want
    assert one(spark, d.notice_excerpt(F.lit("Despacho"), F.col("t"), F.lit(N), array), t=F.lit(text).cast("string")) is None


def test_updated_at(spark):
    read = lambda t: one(spark, F.date_format(d.updated_at(F.col("t")), "yyyy-MM-dd HH:mm"), t=F.lit(t).cast("string"))
    assert read("Última Atualização outubro 8, 2026, 17:25 (UTC)") == "2026-10-08 17:25"
    assert [read(t) for t in ("Última Atualização octubre 8, 2026, 17:25 (UTC)", "outubro 8, 2026", "Última Atualização abril 31, 2026, 17:25 (UTC)", None)] == [None] * 4


def test_long_texts_stay_linear(spark):
    text = "A culpa é de quem causa. " * 40_000
    assert re.match(r"^\d+$", str(one(spark, F.size(d.sentences(F.col("t"))), t=text))) and one(spark, F.size(d.sentences(F.col("t"))), t=text) == 40_000
