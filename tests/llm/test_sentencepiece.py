import random

import numpy as np
import pytest

from lodestrata.llm import sentencepiece_codec as m

PATH = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return m.Vocabulary(PATH)


def best_score(text, v):
    best = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - v.longest), e):
            p = v.pieces.get(text[s:e])
            score = p[0] if p else v.unknown if e == s + 1 else None
            if score is not None:
                best[e] = max(best[e], best[s] + score)
    return best[-1]


def test_streaming_viterbi_is_optimal(vocabulary):
    v, r = vocabulary, random.Random(1)
    score = {i: s for s, i in v.pieces.values()}
    codec = m.Codec(v)
    for _ in range(150):
        t = "".join(r.choice("abcthe in on é ß\nX9 ☃") for _ in range(r.randint(1, 80)))
        marked = m.MARK + t.replace(" ", m.MARK)
        ids = list(m.viterbi(iter(marked), v))
        assert ids == codec.encode(t).tolist()
        total = sum(score.get(i, 0.0) for i in ids) + sum(v.unknown for c in marked if c not in v.pieces)
        assert abs(total - best_score(marked, v)) < 1e-6 * max(1, abs(total))


def test_exact_round_trip_and_library_decoding(vocabulary):
    from sentencepiece import SentencePieceProcessor

    sp, codec = SentencePieceProcessor(model_file=PATH), m.Codec(vocabulary)
    for t in ["", " ", "a  b", "  lead", "▁x▁ ▁", "é\x00\n\n☃ 漢字 𝒳", "x" * 5000, "\n" * 50, "<s> </s> <0x0A>"]:
        ids = codec.encode(t)
        assert codec.decode(ids) == t
        if m.MARK not in t and t and "\x00" not in t:
            assert sp.decode(ids.tolist()) == t


def test_window_stays_bounded(vocabulary):
    def endless():
        for _ in range(20_000):
            yield from "internationalisation"

    assert sum(1 for _ in m.viterbi(endless(), vocabulary)) > 20_000


def test_table(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x")])
    coded = m.encode(docs, check="round_trip")
    assert coded.columns == [*docs.columns, "ids", "n_ids", "round_trip"]
    rows = coded.collect()
    assert all(r.round_trip for r in rows)
    assert next(r for r in rows if r.doc_id == 1).ids is None and next(r for r in rows if r.doc_id == 2).ids == []
    back = m.decode(coded.drop("text"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x")], key=str)
    assert m.encode(docs_of([])).collect() == []


def test_one_routine_decides(vocabulary, monkeypatch):
    """Every unit's ids come from the streaming routine."""
    seen, real = [], m.viterbi
    monkeypatch.setattr(m, "viterbi", lambda unit, v: seen.append(unit) or real(unit, v))
    codec, t = m.Codec(vocabulary), "some words and " + "verylong" * 40 + " words"
    codec.encode(t)
    assert sorted(seen) == sorted(set(codec.split(t))) and max(map(len, seen)) > 300


def test_paths_that_never_meet_cost_in_proportion(vocabulary):
    import time

    codec, t = m.Codec(vocabulary), "a" * 1_000_000
    began = time.time()
    ids = codec.encode(t)
    assert time.time() - began < 60 and codec.decode(ids) == t


def test_commits_in_the_middle(vocabulary, monkeypatch):
    """Ids are given out before the stream ends, and small strides change nothing."""
    read = []

    def stream():
        for c in "internationalisation" * 200:
            read.append(c)
            yield c

    first = next(m.viterbi(stream(), vocabulary))
    assert len(read) < 1000
    r, whole = random.Random(7), {}
    for n in range(40):
        t = "".join(r.choice("abcthe▁in☃") for _ in range(r.randint(100, 700)))
        whole[t] = list(m.viterbi(t, vocabulary))
    monkeypatch.setattr(m, "STRIDE", 20)
    assert all(list(m.viterbi(t, vocabulary)) == ids for t, ids in whole.items()) and first >= 0
