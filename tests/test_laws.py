"""Lines of laws on a made-up text."""

from pyspark.sql import functions as F

from lodestrata.operators import laws

LINES = [
    ("Preâmbulo qualquer", None),
    ("TÍTULO I", None),
    ("Das Coisas", None),
    ("Art. 1º Toda coisa é coisa.", "art1_cpt"),
    ("I - a primeira;", "art1_cpt_inc1"),
    ("a) uma parte;", "art1_cpt_inc1_ali1"),
    ("b) outra;", "art1_cpt_inc1_ali2"),
    ("IV – a quarta:", "art1_cpt_inc4"),
    ("sem rótulo, segue.", "art1_cpt_inc4"),
    ("Pena - perder a coisa.", "art1_cpt"),
    ("§ 2º-A. Outro modo.", "art1_par2-A"),
    ("a) direto no parágrafo;", "art1_par2-A_ali1"),
    ("Parágrafo único. Um só.", "art1_par1u"),
    ("Título Solto (nota)", None),
    ("(Nota depois do título.)", None),
    ("Art. 1.234-B. Cita outra norma:", "art1234-B_cpt"),
    ("“Art citado sem ponto", "art1234-B_cpt"),
    ("§ 9º Dentro das aspas", "art1234-B_cpt"),
    ("I - também”", "art1234-B_cpt"),
    ("§ 1º Fora.", "art1234-B_par1"),
    ('"Abre reta', "art1234-B_par1"),
    ('"II - fecha reta', "art1234-B_par1"),
    ("II - fora de novo.", "art1234-B_par1_inc2"),
    ("Arts. 22 a 24. (Revogados.)", "art22-24"),
    ("I - é texto da faixa", "art22-24"),
    ("Art. x Ilegível", "?_cpt"),
    ("Nome do Capítulo", None),
    ("CAPÍTULO ÚNICO", None),
    ("frase perdida.", None),
    ("Art. 25. Fim.", "art25_cpt"),
    ("Último Título", None),
]


def test_devices(spark):
    text = [x for x, _ in LINES]
    rows = spark.createDataFrame([(1, text), (2, []), (3, None), (4, ["Art. 1º A"])], "k int, p array<string>")
    got = {(r.k, r.n): r for r in laws.law_lines(rows, "k", "p").collect()}
    assert {n: got[1, n].device if (1, n) in got else None for n in range(len(LINES))} == {n: d for n, (_, d) in enumerate(LINES)}
    assert got[1, 10].label == "§ 2º-A." and got[1, 10].text == "Outro modo."
    assert got[1, 17].label is None and got[1, 17].text == "§ 9º Dentro das aspas"
    assert got[1, 24].label is None and got[1, 23].label == "Arts. 22 a 24."
    assert got[4, 0].device == "art1_cpt" and len([k for k, _ in got if k in (2, 3)]) == 0


def test_paragraphs_between_start_and_close(spark):
    close = "Brasília, 1 de maio de 1990; 169º da Independência e 102º da República."
    page = lambda *lines: "<html>" + "".join(f"<p>{x}</p>" for x in lines)
    rows = spark.createDataFrame([(1, page("Menu", "Lei", "Art. 1&ordm; A", " ", close, "Nome")), (2, page("Lei", "a", "Lei", close)), (3, page("Lei", "a")), (4, None)], "k int, h string")
    got = {r.k: r.p for r in rows.select("k", laws.law_paragraphs(F.col("h"), F.lit("Lei")).alias("p")).collect()}
    assert got == {1: ["Art. 1º A"], 2: None, 3: None, 4: None}
