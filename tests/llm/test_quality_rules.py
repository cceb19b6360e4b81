import re
from collections import Counter

from lodestrata.llm import quality_rules as m

from .conftest import words


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    c = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_figures_against_brute_force(spark, docs_of, tmp_path):
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a", "é é é\né é é\n\né é é # | <x>", " ".join(["w"] * 30_000), " ".join(words(1, 20_000) * 2), "x\x0by\x0cz\r\nx\x0by z", "\n".join(["same line here"] * 40), "the and of " + " ".join(words(2, 70))]
    docs_of(list(enumerate(texts)), extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in m.op8_quality_rules(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for n, t in enumerate(texts):
        n_words, chars, symbols, lines, repeats = brute(t)
        r = got[n]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, lines, repeats), n
        assert r.base_failed == (n_words < 50 or 100 * repeats > 50 * n_words)
        assert not (r.base_failed and r.kept)
    assert got[11].kept


def test_rules_name_what_is_broken(docs_of):
    docs = docs_of([(1, "the " + " ".join(w + "***" for w in words(3, 80))), (1, "the " + " ".join(w + "***" for w in words(3, 80))), (2, "short")])
    out = m.score_rules(docs)
    got = {r.doc_id: set(r.broken) for r in out.collect()}
    assert out.count() == 3 and set(docs.columns) <= set(out.columns)
    assert "symbols_per_word" in got[1] and "word_count" in got[2]
    assert m.score_rules(docs_of([])).collect() == []
