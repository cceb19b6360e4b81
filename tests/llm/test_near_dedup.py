import random
from collections import Counter

import numpy as np

from lodestrata.llm import near_dedup as m

from .conftest import words


def classes(docs):
    return {r.d: r.class_id for r in m.near_classes(docs).collect()}


def weighted(texts):
    """The weighted shingles of some texts, with the operator's weights."""
    import math

    split = [t.split() for t in texts]
    df = Counter(w for ws in split for w in set(ws))
    top = math.log(1 + len(texts))
    idf = {w: max(0.0, math.log((1 + len(texts)) / (1 + n))) / top for w, n in df.items()}
    out = []
    for ws in split:
        grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        out.append({g: n * (1 + sum(idf[w] for w in g) / 5) for g, n in grams.items()})
    return out


def similarity(x, y):
    common = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
    return common / (sum(x.values()) + sum(y.values()) - common)


def edit(ws, n, seed):
    r = random.Random(seed)
    ws = list(ws)
    for i in r.sample(range(len(ws)), n):
        ws[i] = f"edit{seed}x{i}"
    return ws


def jaccard(a, b):
    grams = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    x, y = grams(a), grams(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_groups_and_clean_documents(docs_of):
    base, other = words(1, 400), words(2, 400)
    near = [edit(base, 2, s) for s in range(30)]
    rows = [(n, " ".join(t)) for n, t in enumerate([base, *near, base])] + [(100, " ".join(other)), (101, " ".join(words(3, 300))), (102, " ".join(words(4, 3))), (103, " ".join(words(4, 3)))]
    got = classes(docs_of(rows))
    for n in range(1, 32):
        assert got[n] == 0
    assert got[103] == 102 == got.get(102, 102)
    assert got.get(100, 100) == 100 and got.get(101, 101) == 101


def test_half_alike_is_not_near(docs_of):
    a, b = words(5, 200), words(6, 200)
    rows = [(1, " ".join(a)), (2, " ".join(a[:120] + b[:80]))]
    assert jaccard(a, a[:120] + b[:80]) < 0.6
    assert classes(docs_of(rows)) == {}


def test_defined_cases(docs_of):
    t, a, b = (" ".join(words(n, 50)) for n in (7, 27, 28))
    rows = [(1, None), (2, ""), (2, ""), (3, "  \n"), (4, t), (4, t), (None, t), (None, "other words of no other text at all"), (5, t + "\n"), (7, a), (7, b), (None, None), (None, None), (None, a + " end"), (None, b + " end of it")]
    docs = docs_of(rows)
    found = m.near_classes(docs).collect()
    got = {(r.d, r.e): r.class_id for r in found}
    assert sorted(got.values()) == [4, 4, 7, 7] and len(found) == 4
    kept = sorted(((r.doc_id, r.text) for r in m.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, None), (2, ""), (2, ""), (3, "  \n"), (4, t), (None, "other words of no other text at all"), (7, a), (7, b), (None, None), (None, None)], key=str)
    assert m.keep_one(docs).columns == docs.columns
    assert classes(docs_of([])) == {} and m.keep_one(docs_of([])).collect() == []


def test_classes_without_any_id(spark, docs_of, tmp_path):
    t = " ".join(words(31, 60))
    docs_of([(None, t), (None, t + " x"), (9, "short one"), (None, None)], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.class_id) for r in m.op2_near_dedup(spark, str(tmp_path)).collect()]
    ids = [c for i, c in got if i is None]
    assert (9, 9) in got and all(c < 0 for c in ids) and len(set(ids)) == 2


def brute(texts):
    """Class of each text: components of all pairs at the threshold or above."""
    sets, parent = weighted(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= m.SIMILARITY:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_unlike_texts_of_one_bucket_against_brute_force(docs_of, monkeypatch):
    """A passage that all texts share puts unlike texts into one bucket; small groups and few leaders make many rounds."""
    monkeypatch.setattr(m, "GROUP_ROWS", 7)
    monkeypatch.setattr(m, "LEADERS", 2)
    monkeypatch.setattr(m, "FEW_LEADERS", 1)
    monkeypatch.setattr(m, "FIRST_LEADERS", 2)
    monkeypatch.setattr(m, "GROWTH", 2)
    r, passage, texts = random.Random(3), words(40, 60), []
    for f in range(12):  # families of copies around one passage, with some between 0.7 and 0.9
        base = passage + words(50 + f, 40)
        texts += [" ".join(edit(base, r.randint(0, 3), 1000 * f + s)) for s in range(7)]
    r.shuffle(texts)
    got = classes(docs_of(list(enumerate(texts))))
    assert [got.get(n, n) for n in range(len(texts))] == brute(texts)


def test_finer_bands_keep_near_pairs_and_part_unlike_texts():
    r, sets = random.Random(5), []
    common = r.sample(range(1 << 32), 100)
    for f in range(100):
        base = common + r.sample(range(1 << 32), 100)
        sets += [np.unique(np.array(x, np.uint32)) for x in (base, [x if i % 20 else r.randrange(1 << 32) for i, x in enumerate(base)])]
    fps = [f"{n:03}" for n in range(200)]
    batch = m.pa.RecordBatch.from_arrays([m.pa.array(fps), m.pa.array([t.tobytes() for t in sets]), m.pa.array([(t % 251).astype(np.uint8).tobytes() for t in sets])], names=["fp", "tokens", "weights"])
    keys = {}
    for out in m._fine_rows([batch]):
        for k, fp in zip(*(c.to_pylist() for c in out.columns)):
            keys.setdefault(fp, set()).add(k)
    assert all(keys[fps[n]] & keys[fps[n + 1]] for n in range(0, 200, 2))
    assert sum(bool(keys[fps[i]] & keys[fps[j]]) for i in range(0, 200, 2) for j in range(0, i, 2)) < 0.05 * 4950


def test_recall_on_a_thousand_near_pairs(docs_of):
    """Recall of pairs at the threshold or above, by exact similarity; pairs under it stay apart."""
    rows, pairs = [], []
    for f in range(1500):
        base = words(5000 + f, 90 + f % 80)
        other = edit(base, 1 + f % 3 + (f % 10 == 0) * 3, f)
        pairs.append((2 * f, 2 * f + 1))
        rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(other))]
    sets = weighted([t for _, t in rows])
    near = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) >= m.SIMILARITY + 0.01]
    far = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) < m.SIMILARITY - 0.01]
    got = classes(docs_of(rows, extra=False))
    assert len(near) >= 1000 and len(far) >= 100
    assert sum(got.get(b) == a for a, b in near) >= 0.99 * len(near)
    assert not any(got.get(b) == a for a, b in far)


def test_links_of_a_group_match_brute_force():
    r = np.random.default_rng(1)
    tokens = [np.unique(r.integers(0, 60, 40)).astype(np.uint32) for _ in range(30)]
    weights = [(t * 7 % 256).astype(np.uint8) for t in tokens]
    names = [f"{n:02}" for n in range(30)]
    batch = m.Batch(names, names, [t.tobytes() for t in tokens], [w.tobytes() for w in weights])
    value = {int(t): 1 + float(w) / 255 for ts, ws in zip(tokens, weights) for t, w in zip(ts, ws)}
    for i in range(30):
        leader = m.Leader(names[i], names[i], tokens[i], sum(value[t] for t in tokens[i].tolist()))
        alike = batch.alike(leader, 0.6)
        for j in range(30):
            x, y = set(tokens[i].tolist()), set(tokens[j].tolist())
            s = sum(value[t] for t in x & y) / sum(value[t] for t in x | y)
            assert abs(s - 0.6) < 1e-3 or alike[j] == (i != j and s >= 0.6)


def test_consistent_samples_estimate_similarity():
    idf = np.full(1 << m.DF_BITS, 0.5, np.float32)
    a, b = words(9, 300), edit(words(9, 300), 6, 3)
    sig = []
    for ws in (a, b):
        raw = np.frombuffer(" ".join(ws).encode(), np.uint8)
        sig.append(m.signatures(m.Shingles(raw, np.array([0, len(raw)]), idf), 1, 400)[0])
    assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.08
