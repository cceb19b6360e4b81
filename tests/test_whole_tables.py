"""Queries over whole tables that have no DuckDB twin, against plain Python."""

import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from lodestrata.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return lambda name: pq.read_table(f"{D}/{name}.parquet").to_pylist()


def got(spark, name):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, D).collect())


def test_range_join(spark, rows):
    ranges = [(p["p_partkey"], p["p_partkey"] * 3, p["p_partkey"] * 3 + p["p_size"]) for p in rows("part")]
    want = [(r["l_orderkey"], r["l_linenumber"], k) for r in rows("lineitem") for k, a, b in ranges if a <= r["l_partkey"] % 2000 <= b]
    assert got(spark, "range_join") == sorted(want)


def test_paradigm_notes(spark, rows):
    notes = defaultdict(list)
    for c in rows("customer"):
        notes[c["c_custkey"] % 7, c["c_custkey"] % 90].append(f"tema {c['c_custkey']}")
    want = [(o["o_orderkey"], ";".join(sorted(notes.get((o["o_orderkey"] % 7, o["o_custkey"] % 120), [])))) for o in rows("orders")]
    assert got(spark, "paradigm_notes") == sorted(want)


def test_cited_data(spark, rows):
    records = defaultdict(list)
    for o in rows("orders"):
        k = o["o_orderkey"]
        if k % 8:
            records[o["o_custkey"]].append((k, str(o["o_orderdate"])[:10] if k % 5 else None, o["o_orderpriority"] if k % 6 else None))
    want = []
    for c in rows("customer"):
        u = c["c_custkey"]
        day, body = f"1995-03-0{u % 9 + 1}", "2-HIGH" if u % 3 else None
        scored = sorted((int(d is not None and d != day) + int(body is not None and b is not None and b != body), int(d is None) + int(body is not None and b is None), k) for k, d, b in records[u])
        if scored:
            bad, open_, k = scored[0]
            want.append((u, k, "conflict" if bad else "confirmed", bad, open_, len(scored) - 1))
        else:
            want.append((u, None, "unverified", 0, 0, 0))
    found = {r.cite: tuple(r) for r in registry.QUERIES["cited_data"](spark, D).collect()}
    assert found == {w[0]: w for w in want}


def test_canonical_identity(spark, rows):
    near = defaultdict(set)
    for o in rows("orders"):
        a, b = o["o_custkey"], o["o_custkey"] + o["o_orderkey"] % 3 * 7
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {}
    for n in sorted(near):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = n
                todo += near[x]
    assert got(spark, "canonical_identity") == sorted(label.items())


def test_month_gaps(spark, rows):
    have = defaultdict(set)
    for o in rows("orders"):
        have[o["o_custkey"]].add(o["o_orderdate"].year * 12 + o["o_orderdate"].month - 1)
    want = [(k, f"{m // 12}-{m % 12 + 1:02}-01") for k, ms in have.items() for m in range(min(ms), max(ms) + 1) if m not in ms]
    assert want and [(k, str(m)) for k, m in got(spark, "month_gaps")] == sorted(want)


def test_name_caveats(spark, rows):
    names = {c["c_custkey"]: c["c_name"] for c in rows("customer")}
    n = Counter((o["o_orderpriority"], names[o["o_custkey"]]) for o in rows("orders") if o["o_custkey"] in names)
    want = sorted((*k, x, x <= 3) for k, x in n.items())
    assert {w[3] for w in want} == {True, False}
    assert got(spark, "name_caveats") == want


def test_summary_overlap(spark, tmp_path):
    long = " ".join(f"word{n} straße é" for n in range(40))
    texts = {n: f"{long[n * 3 :]} end {n}" if n % 3 else f"only {n} " * 30 for n in range(1, 22)} | {22: "short", 29: long}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bare = lambda x: re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c)))
    want = {}
    for n, x in texts.items():
        if n + 7 in texts:
            b, other = bare(x), bare(texts[n + 7])
            blocks = [b[i : i + 40] for i in range(0, len(b) - 39, 40)]
            want[n] = round(sum(k in other for k in blocks) / len(blocks), 9) if blocks else 0.0
    found = {r.doc_id: r.share for r in registry.QUERIES["summary_overlap"](spark, str(tmp_path)).collect()}
    assert found == want and len(want) == 16 and any(0 < v < 1 for v in want.values())


def test_pooled_lists(spark, rows):
    values = defaultdict(list)
    for d in rows("documents"):
        for n, size in enumerate((300, 500)):
            values[d["doc_id"] % size].append((d["text"], n))
    found = {r.k: (r.v, r.n_lists) for r in registry.QUERIES["pooled_lists"](spark, D).collect()}
    assert found.keys() == values.keys()
    for k, vs in values.items():
        texts = [v for v, _ in vs if v is not None]
        assert (len(found[k][0] or ""), found[k][1]) == (max(map(len, texts), default=0), len({n for _, n in vs}))
    assert max(len(v or "") for v, _ in found.values()) > 60
