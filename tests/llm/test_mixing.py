import random

from lodestrata.llm import mixing as m

SCHEMA = "doc_id long, source string, text string"


def water(sizes, weights, share, most):
    """Targets by raising the level until all is dealt."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    w = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        open_ -= full
    return out


def table(spark, seed=1, n=900):
    r = random.Random(seed)
    names = [None, "src1", "src10", "srcé", "zz", "Src"]
    rows = [(i, r.choice(names + ["src1"] * 3), " ".join(["w"] * r.choice([0, 1, 5, 40, 90, 300]))) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def sizes_of(rows):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    return sizes


def test_targets_and_copies(spark):
    rows, docs = table(spark)
    got = m.plan(docs).collect()
    sizes = sizes_of(rows)
    want = water(sizes, m.WEIGHTS, 1.5, 2.0)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        x = want[r.source] / sizes[r.source] if r.size else 0
        assert r.whole == int(x + 1e-9) and r.whole * r.m + r.ups <= 2 * r.m
        assert int((x - r.whole) * r.m + 1e-9) <= r.ups <= int((x - r.whole) * r.m + 1e-9) + 1
        taken[r.source] += (r.whole * r.m + r.ups) * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.06 * want[s] + 300


def test_repeated_and_missing_ids_meet_their_targets(spark, tmp_path):
    """Rows without an id, and rows that repeat, alike in size: each source is taken within 2 % of its target."""
    r = random.Random(8)
    rows = [(None, "abc"[n % 3], " ".join(["w"] * 100)) for n in range(900)] + [(7, "b", " ".join(["v"] * 50))] * 400 + [(n % 5, "c", " ".join(["u"] * r.randint(20, 60))) for n in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = m.op9_mixing(spark, str(tmp_path)).collect()
    sizes, want, taken = sizes_of(rows), water(sizes_of(rows), m.WEIGHTS, 1.5, 2.0), {}
    assert len(out) == len(rows) and all(x.taken in (0, x.size, 2 * x.size) for x in out)
    for x in out:
        taken[x.source_size] = taken.get(x.source_size, 0) + x.taken
    mixed = sizes_of([tuple(x) for x in m.mix_rows(docs).collect()])
    for s in sizes:
        assert abs(taken[sizes[s]] - want[s]) <= 0.02 * want[s] and mixed[s] == taken[sizes[s]]


def test_many_equal_rows_need_no_long_array(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "RUN", 7)
    spark.createDataFrame([(1, "a", "x y")] * 40 + [(2, "a", "z")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert len(m.op9_mixing(spark, str(tmp_path)).collect()) == 41


def test_reruns_agree_whatever_the_partitions(spark):
    _, docs = table(spark, 2)
    a = sorted(map(str, m.plan(docs).collect()))
    assert a == sorted(map(str, m.plan(docs.repartition(7)).collect()))


def test_pivotal_keeps_the_sum(spark):
    units = spark.range(1000).selectExpr("CAST(id AS STRING) AS key", "'s' AS source", "CAST(10 AS BIGINT) AS size", "CAST(0.37 AS DOUBLE) AS p")
    ups = m.pivotal(units, 1000).collect()
    assert len(ups) == 1000 and len({r.key for r in ups}) == 1000
    assert abs(sum(r.up for r in ups) - 370) <= 1 and {r.up for r in ups} == {0, 1}


def test_duels_are_fair(spark):
    units = spark.range(3000).selectExpr("CAST(id AS STRING) AS key", "CAST(id AS STRING) AS source", "CAST(10 AS BIGINT) AS size", "CAST(0.3 AS DOUBLE) AS p")
    assert abs(sum(r.up for r in m.pivotal(units, 3000).collect()) / 3000 - 0.3) < 0.03


def test_defined_cases(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "a", "x y z"), (3, "a", "x y z"), (None, None, "u v"), (4, None, "u")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = m.plan(docs).collect()
    assert sum(r.m for r in got) == 6 and all(r.whole + r.ups == 0 for r in got if r.size == 0)
    mixed = m.mix_rows(docs.selectExpr("*", "1 AS size", "'k' AS copies"))
    assert mixed.columns == ["doc_id", "source", "text", "size", "copies"]
    assert mixed.count() == sum(r.m * r.whole + r.ups for r in got)
    assert m.plan(spark.createDataFrame([], SCHEMA)).collect() == []
    assert m.plan(spark.createDataFrame([(1, "a", "")], SCHEMA)).collect()[0].target == 0
