import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import passages as m
from lodestrata.operators import merging


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).first()["x"]


def test_passage_has_most_different_words():
    text = "começo " * 30 + "o dano moral e o dano estético coletivo " + "fim " * 40 + "dano"
    got = m.passage_of(text, ["prescrição", "dano moral coletivo"], 60)
    assert "dano moral e o dano estético coletivo" in got and got.startswith("…") and got.endswith("…") and len(got) <= 62
    assert m.passage_of("texto sem nada da tese aqui", ["prescrição"], 10) == "texto sem…"
    assert m.passage_of("", ["a"], 10) == "" and m.passage_of("curto", ["x"], 300) == "curto"


def test_passages_are_slices():
    r = random.Random(2)
    for _ in range(200):
        text = " ".join(r.choice(["dano", "Danos", "móral", "x" * 25, "coletivo", "e", "😀", "imprescritível"]) for _ in range(r.randint(1, 60)))
        got = m.passage_of(text, ["dano moral coletivo", "prescrição"], 50)
        assert got.strip("…") in text and len(got.strip("…")) <= 50 + 25


def test_repeated_blocks():
    assert m.unrepeated("a b c\na b  c") == ("a b  c", 2)
    assert m.unrepeated("a b a b a b (TJ - rodapé 1)") == ("a b a b a b (TJ - rodapé 1)", 1) or m.unrepeated("a b a b a b (TJ - rodapé 1)")[1] in (1, 3)
    assert m.unrepeated("a b a") == ("a b a", 1) and m.unrepeated("") == ("", 1)
    assert m.unrepeated("x x x x")[1] == 4


def test_readings(spark):
    h = one(spark, '<div style="display:none">x</div><p', m.html_hints)
    assert h.cut and h.hidden
    assert not one(spark, "<p hiddenly>hidden</p> ", m.html_hints).hidden
    assert one(spark, "Ementa: CIVIL. Dano", m.search_word) == "CIVIL" and one(spark, "um só", m.search_word) == "acórdão"
    assert one(spark, "uma palavra muito longa", lambda c: m.on_word(c, 12)) == "uma palavra" and one(spark, "inconstitucional", lambda c: m.on_word(c, 5)) == "incon"
    head = "Apelação 0000123-70.2020.8.27.0001 (00001237020208270001)\nEMENTA 9999999-99.2020.8.27.0001"
    assert one(spark, head, lambda c: m.header_number(c, "EMENTA")) == "0000123-70.2020.8.27.0001"
    assert one(spark, head.replace("00001237020208270001", "1111111-70.2020.8.27.0001"), lambda c: m.header_number(c, "EMENTA")) is None
    assert str(one(spark, "20240305101112", m.loose_instant)) == "2024-03-05 10:11:12" and one(spark, "ontem", m.loose_instant) is None
    assert str(one(spark, "2024-03-05T10:00:00.000Z", m.loose_instant)) == "2024-03-05 10:00:00"
    page = '<meta charset="iso-8859-1">ação'.encode("latin-1")
    assert one(spark, bytearray(page), lambda c: m.decoded(c, F.lit("text/html")), "binary").endswith("ação")
    assert one(spark, bytearray("ação".encode()), lambda c: m.decoded(c, F.lit("text/html; charset=nope")), "binary") == "ação"
    assert one(spark, "8.27", m.court_of) == "tjto" and one(spark, "5.24", m.court_of) == "trt24" and one(spark, "8.77", m.court_of) is None


@pytest.mark.parametrize("seed", range(3))
def test_latest_versions_against_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(n, r.randrange(12), r.choice([None, "x", "y", "z"]), r.randrange(3)) for n in range(40)]
    alive = {}
    for n, k, a, b in rows:
        alive.pop(k, None)
        if a is not None:
            for other in [o for o, v in alive.items() if v[1:] == (a, b)]:
                alive.pop(other)
        alive[k] = (n, a, b)
    df = spark.createDataFrame(rows, "o int, k int, a string, b int")
    assert sorted(x.o for x in merging.latest_versions(df, "k", ["a", "b"], "o").collect()) == sorted(v[0] for v in alive.values())


def test_courts(spark):
    assert merging.expand_courts(["stj", "trt", "TRT2"])[:3] == ["stj", "trt1", "trt3"]
    got = merging.expand_courts(["trt2", "trt", "trt2"])
    assert len(got) == len(set(got)) == 24 and merging.expand_courts(["a", "a"]) == ["a", "a"]
    assert merging.registry(spark).count() == 2 + 27 + 24 + 6
    with pytest.raises(ValueError):
        merging.strict_match(spark.range(3), spark.range(2), "id")
    assert list(itertools.islice(m.STATES, 3)) == ["ac", "al", "ap"]
