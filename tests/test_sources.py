import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import readers as m


def test_delimited_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('KEY|NAME|TEXT\n"1"|"who"|"say ""hi""\nthen | go"\n"2"|"x"|""\n')
    rows = m.read_delimited(spark, str(p), ["KEY", "NAME", "TEXT"], "|", drop=("NAME",))
    assert rows.columns == ["KEY", "TEXT"]
    assert [tuple(r) for r in rows.orderBy("KEY").collect()][0] == ("1", 'say "hi"\nthen | go')
    with pytest.raises(m.UnexpectedFormat):
        m.read_delimited(spark, str(p), ["KEY", "TEXT"], "|")
    (tmp_path / "b.csv").write_text('A,B\n"1"\n')
    with pytest.raises(Exception):
        m.read_delimited(spark, str(tmp_path / "b.csv"), ["A", "B"], ",").collect()


def test_html_tables_and_lists(spark):
    page = '<table><tr><th>A</th></tr><tr><td>1</td></tr></table><div class="sumula-item">Súmula 7 (cancelada)</div><div class="sumula-item">Súmula 8</div>'
    df = spark.createDataFrame([(1, page)], "k int, html string")
    assert [r.A for r in m.html_rows(df, "k", "html", ["A"]).collect()] == ["1"]
    with pytest.raises(m.UnexpectedFormat):
        m.html_rows(df, "k", "html", ["B"])
    assert [(r.number, r.mark) for r in m.list_items(df, "k", "html", "sumula-item").collect()] == [(7, "cancelada"), (8, None)]


def test_answers_without_a_list_are_errors(spark):
    with pytest.raises(m.UnexpectedFormat):
        m.search_answers(spark.createDataFrame([(1, '{"other": []}')], "k int, j string"), "k", "j")


def test_data_addresses(spark):
    b = lambda t: "data:text/html;base64," + base64.b64encode(t.encode()).decode()
    rows = [(b("<p>um texto com mais de vinte letras é</p>"),), (b("x"),), ("data:text/html,abc",), ("https://x",), ("data:text/html;base64,@@@@",)]
    got = [r.d for r in spark.createDataFrame(rows, "u string").select(m.data_address(F.col("u")).alias("d")).collect()]
    assert got[0].text == "um texto com mais de vinte letras é" and [g.reason for g in got] == [None, "no_text", "not_base64", "not_html", "bad_base64"]


def test_receipts(spark):
    good = lambda n, i, link, at: (n, i, link, hashlib.sha256(b"x").hexdigest(), 1, bytearray(b"x"), at)
    receipts = [good("r1", "a", "l1", "2024"), good("r2", "a", "l1", "2025"), good("r3", "b", "l2", None), good("r4", "c", "l2", "2024"), ("bad", "d", "l3", "0", 1, bytearray(b"x"), "2024")]
    r = spark.createDataFrame(receipts, "receipt string, id string, link string, sha256 string, size int, content binary, at string")
    w = spark.createDataFrame([(1, "a", None), (2, "z", "l1"), (3, "z", "l2"), (4, "d", "l3"), (5, "b", None)], "ask int, id string, link string")
    assert {x.ask: x.receipt for x in m.receipt_for(w, r).collect()} == {1: "r2", 2: "r2", 5: "r3"}


def test_incomplete_answers_are_errors(spark):
    from lodestrata.sources import answers

    for body in ('{"timed_out":true,"hits":{"hits":[]}}', '{"_shards":{"failed":1},"hits":{"hits":[]}}', "{}"):
        with pytest.raises(m.UnexpectedFormat):
            answers.registers(spark.createDataFrame([(body,)], "b string"), "b", "1")
    with pytest.raises(m.UnexpectedFormat):
        answers.notices(spark.createDataFrame([("[]",)], "b string"), "b")


def test_archives(spark, tmp_path):
    import zipfile

    from lodestrata.sources import answers

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "hi")
        z.writestr("z.bin", b"\x00\x01")
    rows = answers.archive_members(spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))).collect()
    assert {(r.member, bytes(r.content)) for r in rows} == {("x/y.txt", b"hi"), ("z.bin", b"\x00\x01")}


def test_store_keeps_the_newest_live_answer(spark, tmp_path):
    import datetime as dt

    from lodestrata.sources import stores

    now = dt.datetime(2024, 1, 10, 12)
    rows = [("q1", 1, now - dt.timedelta(hours=30)), ("q1", 2, now - dt.timedelta(hours=5)), ("q1", 3, now - dt.timedelta(hours=2)), ("q2", 4, now - dt.timedelta(hours=25)), ("q3", 5, now + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "q string, v int, ts timestamp")
    stores.put(df, f"{tmp_path}/s", F.col("q"), F.col("ts"))
    got = stores.get(spark, f"{tmp_path}/s", F.lit(now)).collect()
    assert len(got) == 1 and '"v":3' in got[0].payload
    assert stores.response(df.limit(1), ["q", "v"]).first().json == '{"q":"q1","v":1}'
