import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import quality_classifier as m

from .conftest import words

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    vocabulary = words(1, 300)
    rows, labels = [], []
    for n in range(300):
        good = n % 5 != 0
        ws = [vocabulary[(n * 37 + k * k * 11) % 300] for k in range(60)]
        rows.append((n, " ".join(ws) + "." if good else " ".join(w + "***" for w in ws)))
        if n % 2:
            labels.append((n, int(good), 0))
    return rows, labels


def test_rejects_junk_and_keeps_clean_text(spark, docs_of):
    rows, labels = corpus()
    docs = docs_of(rows)
    kept = {r.doc_id for r in m.keep_target(docs, spark.createDataFrame(labels, LABELS)).collect()}
    held_good = [n for n, _ in rows if n % 2 == 0 and n % 5]
    assert len([n for n in held_good if n in kept]) >= 0.97 * len(held_good)
    assert len([n for n, _ in rows if n % 5 == 0 and n in kept]) <= 2


def test_scores_against_brute_force(spark, docs_of):
    rows, labels = corpus()
    docs, labels = docs_of(rows), spark.createDataFrame(labels, LABELS)
    model = m.fit(docs, labels)
    target = {r.doc_id for r in labels.collect() if r.quality}
    raw, aim = np.zeros(m.BUCKETS), np.zeros(m.BUCKETS)
    own = {}
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        own[i] = np.bincount(m.features(data, np.array([0, len(data)]))[1], minlength=m.BUCKETS)
        raw += own[i]
        aim += own[i] * (i in target)
    scale = aim.sum() / raw.sum()
    got = {r.doc_id: r.log_ratio for r in m.score(docs, model).collect()}
    for i, c in own.items():
        at = np.flatnonzero(c)
        want = sum(c[b] * np.log((aim[b] - c[b] * (i in target) + 1) / ((raw[b] - c[b]) * scale + 1)) for b in at)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want))


def test_top_k_is_exact(spark):
    keys = [(int(x),) for x in np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500)]
    df = spark.createDataFrame(keys, "k long")
    order = sorted((k for (k,) in keys), reverse=True)
    for k in (1, 7, 499, 500):
        assert m.kth_largest(df, "k", k) == order[k - 1]
    assert m.kth_largest(df, "k", 501) is None


def test_defined_cases(spark, docs_of):
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], LABELS)
    docs = docs_of([(1, None), (2, ""), (None, "x"), (3, "a b"), (3, "a b")])
    out = m.keep_target(docs, none)
    assert out.count() == 5 and out.columns == docs.columns
    some = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (77, 1, 0)], LABELS)
    first = sorted(map(str, m.keep_target(docs, some).collect()))
    assert first == sorted(map(str, m.keep_target(docs.withColumn("n_chars", F.col("n_chars")), some).collect()))
    assert m.keep_target(docs_of([]), some).collect() == []
    clash = docs.withColumns({"log_ratio": F.lit("mine"), "sample_key": F.lit("mine")})
    assert {r.log_ratio for r in m.keep_target(clash, some).collect()} == {"mine"}


def test_keeps_clean_text_of_a_mostly_bad_corpus(spark, docs_of):
    vocabulary = words(1, 300)
    rows = []
    for n in range(600):
        ws = [vocabulary[(n * 37 + k * k * 11) % 300] for k in range(60)]
        rows.append((n, " ".join(ws) + "." if n % 10 == 0 else " ".join(w + "***" for w in ws)))
    labels = spark.createDataFrame([(n, int(n % 10 == 0), 0) for n in range(600) if n % 20 < 10], LABELS)
    docs = docs_of(rows)
    assert abs(m.fit(docs, labels).share - 0.1) < 1e-9
    kept = {r.doc_id for r in m.keep_target(docs, labels).collect()}
    good = {n for n, _ in rows if n % 10 == 0}
    assert len(good & kept) >= 0.97 * len(good)
    assert len(kept - good) <= 2
