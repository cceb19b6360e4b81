"""Sources, sinks and lists on small inputs."""

from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import evaluate, fusion, merging
from lodestrata.plans import registry
from lodestrata.sources import answers, readers, stores
from lodestrata.streaming import limits

D = "/root/testdata/sf0.001"


def test_every_file_has_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|2\n")
    (tmp_path / "b.csv").write_text("x|z\n3|4\n")
    with pytest.raises(Exception):  # noqa: B017 - whichever file is read first, one of them is refused
        readers.read_delimited(spark, str(tmp_path), ["x", "y"], "|").collect()


def test_credit_brake_against_a_loop(spark):
    by = defaultdict(list)
    for r in pq.read_table(f"{D}/events.parquet").to_pylist():
        by[r["user_id"] % 50].append(r)
    want = set()
    for user, rows in by.items():
        state = None
        for r in sorted(rows, key=lambda r: (int(r["ts"].timestamp() * 1000), r["event_id"])):
            kind, left = r["event_type"], r["event_id"] * 37 % 60
            event = {"error": "answer", "signup": "release_answer"}.get(kind, "call")
            said, state = limits.brake(state, int(r["ts"].timestamp() * 1000), event, left if event != "call" else None)
            want.add((user, r["event_id"], said))
    got = registry.QUERIES["credit_brake"](spark, D).select("user_id", "event_id", "decision").collect()
    assert {tuple(r) for r in got} == want


def test_snippets_take_the_largest_size_that_fits(spark):
    rows = spark.createDataFrame([(n, "a" * 200) for n in range(10)] + [(10, None)], "k int, t string")
    sizes = lambda budget: [len(r.shown) for r in fusion.fit_snippets(rows, "k", "t", budget).orderBy("k").collect()]
    assert sizes(2000) == [111] * 10 + [0]
    assert sizes(809) == [61] * 10 + [0]
    assert sizes(100) == [41, 41] and sizes(0) == []
    assert fusion.fit_snippets(rows.limit(0), "k", "t", 5).count() == 0


def test_a_tenth_of_controls(spark):
    pool, rest = spark.range(100).withColumnRenamed("id", "k"), spark.range(20_000).withColumnRenamed("id", "k")
    got = evaluate.blind_pool(pool, rest, "k", 3)
    assert 1_800 < got.where("control").count() < 2_200
    assert got.where("not control").count() == 100
    assert got.exceptAll(evaluate.blind_pool(pool, rest, "k", 3)).count() == 0


@pytest.mark.parametrize("wanted", [["trt"], ["tjgo", "TRT", "trt2", "trt"], ["tjgo", "stj"], ["trt5", "trt5", "trt"], []])
def test_court_lists_as_the_list_form(spark, wanted):
    rows = spark.createDataFrame([(1, wanted)], "k int, c array<string>")
    got = [r.court for r in merging.court_lists(rows, "k", "c").orderBy("place").collect()]
    assert got == merging.expand_courts(wanted)


def test_theme_without_process_stays(spark):
    themes = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, " b ", "S", "", 2), (1, "a", "S", None, 3), (1, "b", "S", "", 1), (1, "c", "N", "", 0), (1, "d", "S", "x", 0), (1, " ", "S", "", 0)], "k int, p string, l string, w string, n int")
    got = {r.k: r.processes for r in merging.theme_processes(themes, rows, "k", "p", "l", "w", "n").collect()}
    assert got == {1: ["b", "a"], 2: None}


def test_index_order_missing_first(spark):
    rows = spark.createDataFrame([(1, "2024", "b"), (2, None, "z"), (3, "2024", None), (4, "2024", "b")], "k int, d string, r string")
    got = merging.index_order(rows, "d", "r", "k").orderBy("place").collect()
    assert [r.k for r in got] == [2, 3, 1, 4]


def test_index_state_without_anything(spark):
    schema = "k int, bytes int, modified int, sha256 string"
    files = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, None)], schema)
    receipts = spark.createDataFrame([(1, "a"), (2, "a")], "k int, sha256 string")
    got = {r.k: r.reason for r in stores.index_state(files, receipts, spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "a")], schema), "k").collect()}
    assert got == {1: None, 2: "content_changed"}
    assert {r.reason for r in stores.index_state(files, receipts, files.limit(0), "k").collect()} == {"no_index"}


def test_merged_copies(spark):
    rows = spark.createDataFrame([("a", 1, [0], 4, "x"), ("a", 2, [2, 0], 1, "x"), ("b", 3, [1], 0, "x"), ("b", 3, [1], 7, None), ("c", 4, [1], 0, "y"), ("c", 5, [0], 0, "x")], "k string, id int, f array<int>, p int, d string")
    got = {r.k: (r.n_ids, r.formulations, r.best_position, r.dates_differ) for r in merging.copies_merged(rows, "k", "id", "f", "p", "d").collect()}
    assert got == {"a": (2, [0, 2], 1, None), "b": (1, [1], 0, None), "c": (2, [0, 1], 0, ["x", "y"])}


def test_reasons_as_a_map(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, r string").where("r is not null")
    assert {r.k: r.counts for r in fusion.reason_counts(rows, F.col("k"), "r").collect()} == {1: {"a": 1, "b": 2}}


def _page(total, *cards):
    return f'<input id="hdnTotalResultado" value="{total}">' + "".join(cards)


def _card(n, summary="S", process="0000001-11.2020.4.04.7000/TRF4 AC - Ação", link="https://x.trf4.jus.br/d?id_jurisprudencia={n}"):
    field = lambda k, v: f'<div class="resLabel">{k}</div><div class="resValue">{v}</div>'
    values = [("PROCESSO", process), ("DATA DO JULGAMENTO", "05/03/2024"), ("DATA DA PUBLICAÇÃO", "06/03/2024"), ("RELATOR", "Ana"), ("EMENTA", summary)]
    return f'<div class="resultadoItem" id="resultado{n}"><a data-link="{link.format(n=n)}">x</a>' + "".join(field(*v) for v in values) + "</div>"


def _cards(spark, html):
    return answers.cards(spark.createDataFrame([(1, html)], "k int, h string"), "k", "h", "TRF4", r"trf4\.jus\.br").orderBy("position").collect()


def test_cards(spark):
    got = _cards(spark, _page(3, _card(7), _card(8, ""), _card(7)))
    assert [(r.id, r.summary, r.n_repeated, str(r.published)) for r in got] == [("7", "S", 1, "2024-03-06"), ("8", None, 0, "2024-03-06")]
    assert _cards(spark, _page(0)) == []


@pytest.mark.parametrize(
    "html",
    [_page(2, _card(7)), _card(7), _page(1, _card(7, process="no number")), _page(1, _card(7, link="https://other.br/d?id_jurisprudencia=7")), _page(1, _card(7, link="https://x.trf4.jus.br/d?id_jurisprudencia=9")), _page(2, _card(7), _card(7, "other"))],
)
def test_cards_out_of_form_are_an_error(spark, html):
    with pytest.raises(Exception, match="unexpected format"):
        _cards(spark, html)
