import re
import unicodedata

from pyspark.sql import functions as F

from lodestrata.functions import text as m


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_fold_is_that_of_unicode(spark):
    letters = "".join(map(chr, range(0xC0, 0x24F))) + "é Çà É ß"
    got = one(spark, letters, m.fold)
    want = "".join(c for c in unicodedata.normalize("NFD", letters.lower()) if not 0x300 <= ord(c) <= 0x36F)
    assert got == want == m.fold_plain(letters)


def test_spaces(spark):
    assert one(spark, " a  b\n\tc﻿ ", m.squeeze) == "a b c"


def test_summary_key_keeps_accents(spark):
    assert one(spark, "  EMENTA :  Ação  de\nX", m.summary_key) == "ação de x"


def test_words_and_stems(spark):
    assert one(spark, "O dano moral, para a pessoa do réu", m.words) == ["dano", "moral", "pessoa", "reu"]
    found = {s.key: s for s in m.stems("danos prescrição imprescritível lei")}
    assert set(found) == {"dano", "prescr", "impres"}
    for word, key in (("dano", "dano"), ("danos", "dano"), ("imprescritivel", "prescr"), ("prescritivel", "impres")):
        assert re.search(found[key].java, word) and re.search(found[key].re2, word)
    assert not re.search(found["dano"].java, "danosos") and not re.search(found["prescr"].java, "subprescricao")


def test_adherence_is_the_best_share(spark):
    f = lambda t: one(spark, t, lambda c: m.adherence(m.fold(c), ["dano moral coletivo", "prescrição"]))
    assert f("Dano moral") == 2 / 3 and f("Imprescritível") == 1.0 and f("nada") == 0.0
    assert one(spark, "x", lambda c: m.adherence(c, ["de a o"])) == 0.0


def test_expression_has_borders(spark):
    has = lambda t, e: one(spark, t, lambda c: m.normalise(c).rlike(m.expression(e)))
    assert has("A multa\nadministrativa.", "Multa  Administrativa") and not has("multas", "multa") and has("c++ é", "c++")


def test_cut_summaries(spark):
    f = lambda t: one(spark, t, m.seems_cut)
    assert f("termina no meio da") and f("fim. IV.") and not f("Fim.") and not f("texto\nDesembargador Relator")
    assert not f("Fim.\n\n(TJPA – classe – 1)") and not f("")


def test_mended(spark):
    broken = "Ação é ótima".encode().decode("latin-1")
    assert one(spark, broken, m.mended) == "Ação é ótima"
    assert one(spark, "Ação é ótima", m.mended) == "Ação é ótima"


def test_html_text(spark):
    page = "<html><script>x<p></script><p>A&nbsp;&amp;lt; b</p><!-- c --><div>c\nd</div></html>"
    assert one(spark, page, m.html_text) == "A &lt; b\nc d"


def test_truncated_and_cleaned(spark):
    assert one(spark, "abcdef", lambda c: m.truncated(c, 3)) == "abc…"
    assert one(spark, "<b>x</b> https://a.b/c me@x.org 123.456.789-00", m.cleaned) == "x [endereço retirado] [e-mail retirado] [número retirado]"
    assert one(spark, "see www.a.b/c, a1b2c3d4e5f6g7h8i9j0 but internationalizations stay `x`", m.cleaned) == "see [endereço retirado] [código retirado] but internationalizations stay x"
    assert one(spark, "z" * 300, m.cleaned) == "z" * 199 + "…"


def test_character_references(spark):
    page = "<p>&eacute;&#233;&#xE9; &amp;eacute; &mdash;&unknown; &#0; &aring&nbsp;x &#128512;</p><dl><dt>a<dd>b</dl>"
    assert one(spark, page, m.html_text) == "ééé &eacute; —&unknown; &#0; &aring x 😀\na\nb"
    assert one(spark, "a &lt;b&gt; &amp;amp;", m.html_text) == "a <b> &amp;"
