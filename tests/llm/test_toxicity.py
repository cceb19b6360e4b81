import random
import zlib

import numpy as np

from lodestrata.llm import toxicity as m

from .conftest import words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    r, vocabulary = random.Random(1), words(1, 400)
    rows, labels = [], []
    for i in range(n):
        ws = [r.choice(vocabulary) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            ws[r.randrange(40)] = r.choice(["Scumbag", "vermin", "idiotic"])
        if (toxic and r.random() < 0.6) or (not toxic and r.random() < 0.1):
            ws[r.randrange(40)] = "muslims"  # named more often in toxic texts
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs_of, tmp_path):
    rows, labels = corpus()
    docs_of(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in m.op10_toxicity(spark, str(tmp_path)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _ in rows)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_held_out_labels_are_never_read(spark, docs_of):
    rows, labels = corpus(300)
    docs = docs_of(rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a = m.fit(docs, spark.createDataFrame(labels, LABELS))
    b = m.fit(docs, spark.createDataFrame(flipped, LABELS))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_swapped_sentences_get_one_score(monkeypatch):
    """A group that toxic texts name far more often: a neutral sentence scores alike with each group's name."""
    r, vocabulary = random.Random(2), words(1, 500)
    data, toxic = [], []
    for i in range(3000):
        ws = [r.choice(vocabulary) for _ in range(30)]
        bad = i % 3 == 0
        if bad and r.random() < 0.7:
            ws[r.randrange(30)] = r.choice(["scumbag", "vermin", "idiotic"])
        if r.random() < (0.6 if bad else 0.05):
            ws[r.randrange(30)] = "transgender"
        if r.random() < 0.05:
            ws[r.randrange(30)] = r.choice(["women", "men", "muslims", "jews"])
        data.append(m.buckets_of(" ".join(ws)).astype(np.uint32))
        toxic.append(int(bad))
    toxic = np.array(toxic)

    def spread(model):
        neutral = " ".join(vocabulary[:12])
        scores = [float(model.score(np.array([model.weights[m.buckets_of(f"{neutral} {term}")].sum()]))[0]) for term in ("transgender", "women", "men", "nonbinary")]
        return max(scores) - min(scores)

    fair = m.train(data, toxic)
    assert spread(fair) < 0.05
    said = lambda text: float(fair.score(np.array([fair.weights[m.buckets_of(text)].sum()]))[0])
    assert said(vocabulary[3] + " scumbag") > 0.5 and said(vocabulary[3] + " scumbag") > said(vocabulary[3]) + 0.3
    monkeypatch.setattr(m, "COUNTERFACTUAL", 0.0)
    assert spread(m.train(data, toxic)) > 0.2


def test_sample_is_bounded_by_rows(spark, docs_of, monkeypatch):
    seen = []
    real = m.train
    monkeypatch.setattr(m, "train", lambda rows, *a, **k: seen.append(len(rows)) or real(rows, *a, **k))
    rows = [(1, " ".join(words(n, 5))) for n in range(500)] + [(2, "one text"), (3, "another")]
    m.fit(docs_of(rows), spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], LABELS), fit_rows=1)
    assert max(seen) <= 1


def test_long_labelled_texts_are_learned_from(spark, docs_of):
    rows = [(i, " ".join(words(i, 30) + (["vermin"] if i % 2 else [])) + (" filler" * 60_000 if i % 7 == 0 else "")) for i in range(60)]
    labels = [(i, 1, i % 2) for i in range(60)]
    model = m.fit(docs_of(rows), spark.createDataFrame(labels, LABELS))
    assert model.weights[m.bucket_of("vermin")] > 0


def test_defined_cases(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "Word"), (3, "a"), (3, "a")])
    none = m.fit(docs, spark.createDataFrame([(None, 1, 1), (1, 1, None)], LABELS))
    out = m.score_toxicity(docs, none)
    assert out.count() == 5 and {r.score for r in out.collect()} == {0.0}
    assert out.columns == [*docs.columns, "score"]
    assert m.score_toxicity(docs_of([]), none).collect() == []
