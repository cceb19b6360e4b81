import hashlib
import random

from lodestrata.llm.fingerprints import Tree, compare, edited, fingerprint, fingerprint_chain, likeness, locate_edits

from .conftest import words
from .test_substring_dedup import text_order


def mark(text):
    return fingerprint((text or "").encode())


def by_force(a, b):
    """Likeness without arrays: strike out equal sections, then paragraphs, then leaves."""

    def tree(fp):
        t = Tree(fp)
        return [[(p, [(int(t.leaves[k]), int(t.words[k])) for k in range(len(t.leaves)) if t.in_paragraph[k] == j]) for j, p in enumerate(t.paragraphs.tolist()) if t.in_section[j] == i] for i in range(len(t.sections))], t.sections.tolist(), t.root

    (x, xs, xr), (y, ys, yr) = tree(a), tree(b)
    total = sum(n for t in (x, y) for s in t for _, leaves in s for _, n in leaves)
    if xr == yr:
        return 1.0
    if not all(sum(n for s in t for _, leaves in s for _, n in leaves) for t in (x, y)):
        return 0.0

    def strike(p, q, key):
        rest, out = list(q), []
        for i in p:
            hit = next((j for j in rest if key(i) == key(j)), None)
            if hit is None:
                out.append(i)
            else:
                rest.remove(hit)
        return out, rest

    x, y = strike(list(zip(xs, x)), list(zip(ys, y)), lambda s: s[0])
    x, y = strike([p for _, s in x for p in s], [p for _, s in y for p in s], lambda p: p[0])
    x, y = strike([leaf for _, s in x for leaf in s], [leaf for _, s in y for leaf in s], lambda leaf: leaf)
    return min((total - sum(n for _, n in x + y)) / total, 1 - 1 / (total + 1))


def test_chain_against_brute_force(docs_of):
    rows = [(n * 3, "\n".join(" ".join(words(n * 9 + k, 12)) for k in range(n % 7 + 1))) for n in range(25)] + [(1, None), (2, ""), (4, "é漢𝒳\n" * 9)]
    got = {r.doc_id: r for r in fingerprint_chain(docs_of(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(order):
        text, after = t or "", order[(n + 1) % len(order)][1] or ""
        new = edited(text, after)
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == mark(text) and got[i].edited_fingerprint == mark(new)
        assert abs(got[i].near_edited - by_force(got[i].fingerprint, got[i].edited_fingerprint)) < 1e-12
        assert abs(got[i].near_next - by_force(got[i].fingerprint, mark(after))) < 1e-12
        lost, kept = text.split("\n"), new.split("\n")
        assert got[i].n_edited >= sum(p not in kept for p in lost)


def test_hot_ids_lie_in_many_partitions(spark, docs_of):
    rows = [(None, " ".join(words(n, 30))) for n in range(300)] + [(5, "x"), (None, "x"), (None, "x")]
    got = fingerprint_chain(docs_of(rows)).collect()
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else -r[0], text_order(r[1])))
    want = sorted(hashlib.sha256(edited(t, order[(n + 1) % len(order)][1]).encode()).hexdigest() for n, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want


def test_small_tables(docs_of):
    assert fingerprint_chain(docs_of([])).collect() == []
    one = fingerprint_chain(docs_of([(None, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert len(fingerprint_chain(docs_of([(1, "a"), (1, "a"), (1, None)])).collect()) == 3


def test_edits_are_located():
    a = [" ".join(words(n, 8)) for n in range(60)]
    b = list(a)
    b[17] = "changed"
    x, y = mark("\n".join(a)), mark("\n".join(b))
    assert locate_edits(x, y) == ([(17, 18)], [(17, 18)])
    assert locate_edits(x, x) == ([], []) and likeness(x, x) == 1.0
    assert 0.9 < likeness(x, y) < 1.0
    assert locate_edits(x, mark("\n".join(a[:20] + ["new", "lines"] + a[20:]))) == ([], [(20, 22)])


def test_likeness_is_read_from_the_fingerprints():
    r = random.Random(2)
    for n in range(60):
        a = [" ".join(words(n * 50 + k, r.randint(0, 14))) for k in range(r.randint(1, 12))]
        b = [x if r.random() < 0.6 else " ".join(words(9000 + n * 50 + k, 5)) for k, x in enumerate(a)]
        if n % 3 == 0:
            r.shuffle(b)
        if n % 4 == 0:
            b += b[:2]
        x, y = mark("\n".join(a)), mark("\n".join(b))
        assert abs(likeness(x, y) - by_force(x, y)) < 1e-12 and likeness(x, y) == likeness(y, x)
        assert (likeness(x, y) == 1.0) == (a == b)


def test_shape_of_fingerprints():
    t = Tree(mark("one two\n\nthree"))
    assert len(t.paragraphs) == 3 and len(t.sections) >= 2 and t.total == 3
    assert mark("a") != mark("a ") and 0 < likeness(mark("a b c"), mark(" a b c")) < 1
    assert likeness(mark(""), mark(" ")) == 0.0 and mark(None) == mark("")
    long = Tree(mark("w " * 5000))
    assert long.words.max() <= 200 and long.total == 5000
    near = compare(Tree(mark(" ".join(words(1, 300)))), Tree(mark(" ".join(words(1, 200) + words(2, 100)))))[0]
    assert 0.55 < near < 0.75
