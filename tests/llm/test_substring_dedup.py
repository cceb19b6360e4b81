import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.llm.substring_dedup import parse, rlz_factors

from .conftest import words


def brute(rows, window):
    """What each (doc_id, text) row keeps, by comparing every window; texts under one id come in the order of the op's hash."""
    number = {t: n for n, t in enumerate(sorted({t or "" for _, t in rows}, key=text_order))}
    key = lambda i, t: ((1 << 63) - 1 if i is None else i, number[t or ""])
    first = {}
    split = [(i, t, (t or "").encode().split()) for i, t in rows]
    for i, t, ws in split:
        for p in range(len(ws) - window + 1):
            k, at = tuple(ws[p : p + window]), (*key(i, t), p)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t, ws in split:
        late = [p for p in range(len(ws) - window + 1) if first[tuple(ws[p : p + window])] != (*key(i, t), p)]
        gone = {p + x for p in late for x in range(window)}
        out.append((i, b" ".join(w for p, w in enumerate(ws) if p not in gone).decode()))
    return sorted(out, key=str)


def text_order(text):
    """xxhash64 with Spark's seed, signed."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def run(docs, window):
    return sorted(((r.doc_id, r.kept_text) for r in rlz_factors(docs, window).collect()), key=str)


def test_against_brute_force(docs_of):
    a, b, c = words(1, 60), words(2, 60), words(3, 30)
    rows = [
        (5, " ".join(a + b)),
        (2, " ".join(b[10:50] + c + a[5:40])),  # two sources, straddling factors
        (9, " ".join(a[:30] + ["x"] + a[:30])),  # repeats itself
        (3, " ".join(["w"] * 70)),  # period one
        (4, " ".join(["w", "v"] * 30)),
        (7, " ".join(a + b)),  # a copy
        (8, "\t\n ".join(a + b)),  # a copy but for spaces
        (1, ""),
        (6, None),
        (None, " ".join(a[20:59])),
        (10, " ".join(c[:19])),  # under a window
        (11, " ".join(c)),
    ]
    assert run(docs_of(rows), 20) == brute(rows, 20)


def test_repeated_rows_and_ids(docs_of):
    a = " ".join(words(4, 50))
    rows = [(1, a), (1, a), (2, a), (2, a)]
    assert run(docs_of(rows), 20) == brute(rows, 20)


def test_unrelated_texts_of_one_id_keep_their_words(docs_of):
    a, b, c, d = (" ".join(words(n, 60)) for n in (11, 12, 13, 14))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, d), (None, d), (3, a[50:] + " " + b)]
    got = run(docs_of(rows), 20)
    assert got == brute(rows, 20)
    assert (2, b) in got and (None, c) in got and got.count((None, d)) == 2


def test_empty_table(docs_of):
    assert run(docs_of([]), 20) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=60), min_size=1, max_size=8))
def test_few_words(docs_of, texts):
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    assert run(docs_of(rows), 20) == brute(rows, 20)


def test_parse_checks_factor_boundaries():
    import numpy as np

    pos, sd, se, sp = np.array([0, 1, 2, 3]), np.array([1, 1, 2, 2]), np.zeros(4, int), np.array([7, 8, 0, 1])
    assert parse(pos, sd, se, sp, 20) == [(0, 21, 1, 7), (2, 21, 2, 0)]


def test_query_digest(spark, docs_of, tmp_path):
    from lodestrata.llm.substring_dedup import op1_substring_dedup

    t = " ".join(words(5, 40))
    docs_of([(1, t), (2, t)], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[1].n_removed == 0 and got[1].kept_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[2].n_removed == 40 and got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
