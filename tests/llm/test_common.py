import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common as c
from lodestrata.llm import components as components_module
from lodestrata.llm.components import components


def test_words_are_those_of_the_pattern():
    import re

    r = random.Random(3)
    texts = ["".join(r.choice("ab é \t\n\x0b\x0c\r 漢") for _ in range(r.randint(0, 30))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(x) for x in raw])
    w = c.Words(np.frombuffer(b"".join(raw), np.uint8), offs)
    flat = [b"".join(raw)[a:b].decode() for a, b in zip(w.starts, w.ends)]
    assert flat == [x for t in texts for x in re.findall(c.WORD, t)]
    h = w.hashes()
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_later_occurrences_over_many_partitions(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3, r.randrange(100)]), 0, r.randrange(100), r.randrange(3), r.randrange(4)) for _ in range(2000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        found = list(map(tuple, c.later_occurrences(spark.createDataFrame(rows, "k1 long, k2 int, d long, e long, pos int"), "t").collect()))
        got = sorted(set(found))
        keys = [(k, (d, e, p)) for k, _, d, e, p in rows]
        first = {}
        for k, at in keys:
            first[k] = min(first.get(k, at), at)
        assert got == sorted({(*at, *first[k]) for k, at in keys if at != first[k]})
        assert len(found) <= len({x for x in keys}) + 13  # repeated rows are given once a partition
        seen = sorted(set(map(tuple, c.repeated_keys(spark.createDataFrame([(k, *at[:2], n) for n, (k, at) in enumerate(keys)], "a long, d long, e long, s int"), "t").collect())))
        count = {}
        for k, _ in keys:
            count[k] = count.get(k, 0) + 1
        assert seen == sorted((*at[:2], n) for n, (k, at) in enumerate(keys) if count[k] > 1)
        same = c.repeated_keys(spark.createDataFrame([(5, 1, 1, 1)] * 30 + [(6, 2, 2, 2)], "a long, d long, e long, s int"), "t").distinct().collect()
        assert list(map(tuple, same)) == [(1, 1, 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(200, 200)]
    r = random.Random(9)
    r.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 150)} == {100} and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long").where(F.lit(True)), "t").collect() == []
    named = {r.node: r.label for r in components(spark.createDataFrame([("c", "b"), ("b", "a"), ("z", "y")], "a string, b string"), "t").collect()}
    assert named == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_bounded_arrays_change_nothing(monkeypatch):
    from lodestrata.llm import substring_dedup as d

    r = random.Random(6)
    raw = " ".join(r.choice(["a", "bb", "ccc", "x" * 50]) for _ in range(3000)).encode()
    data, offs = np.frombuffer(raw, np.uint8), np.array([0, 1000, len(raw)])
    w = c.Words(data, offs)
    h, (_, _, pos) = w.hashes(), d._anchors(w.hashes(), w, 20)
    monkeypatch.setattr(c, "HASH_BYTES", 100)
    monkeypatch.setattr(d, "STEP", 7)
    assert np.array_equal(h, w.hashes()) and np.array_equal(pos, d._anchors(h, w, 20)[2])
