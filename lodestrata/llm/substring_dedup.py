"""Substring dedup by Relative Lempel-Ziv parsing.

The reference of a document is every text before it (smaller doc_id, then earlier start). Reference
blocks are the windows of `window` words, indexed by a 96-bit fingerprint (chance that two of 1e13
unequal windows meet: about 1e-3). Only windows whose minimizer (least hashed k-gram in the window)
stands twice in the corpus can repeat, so only those are indexed; equal windows share theirs. The
parse goes greedily through a document: a factor starts at the first word from which a whole window
stands earlier, and grows while the next window is the next one of the same reference run; at each
factor boundary the windows that start inside the last window - 1 words are checked again, so a
match that straddles two factors is found too. Factors are at least `window` words long.

Defined cases: null and empty texts and texts under `window` words keep all words; a null doc_id
comes after every other; different texts under one doc_id (or none) are documents of their own, in
the order of a hash of the text, and judged apart; rows equal in doc_id and text have one place, so
neither makes the other repeat and both keep the same words; copies of a whole text under another
doc_id are one factor. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, doc_key, gram_hash, inside, later_occurrences, release, repeated_keys, row_hash, signed, sliding_min, table, tasks_for, text_slices

GRAM = 6
STEP = 1 << 20
FACTOR = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ref_doc", T.LongType()), T.StructField("ref_start", T.IntegerType())])


def _anchors(h: np.ndarray, w: Words, window: int):
    """(window starts, grams hashes, anchor position of each): the minimizer of every whole window."""
    ok = np.flatnonzero(inside(w.first, w.counts, window))
    if not len(ok):
        return ok, None, None
    g = gram_hash(h, GRAM, 21)
    low, width = np.uint64((1 << 24) - 1), window - GRAM + 1
    pos = np.empty(len(g) - width + 1, np.int64)
    for s in range(0, len(pos), STEP):  # places fit the low bits, whatever the length of a text
        part = g[s : s + STEP + width - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        pos[s : s + STEP] = s + (sliding_min(key, width) & low).astype(np.int64)
    pos = pos[ok]
    return ok, g, pos


def _runs(ok: np.ndarray, pos: np.ndarray, row: np.ndarray):
    """First index of each run of windows of one row with one anchor."""
    new = np.ones(len(ok), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (row[ok][1:] != row[ok][:-1])
    return new


def _anchor_rows(window: int):
    schema = pa.schema([("a", pa.int64()), ("d", pa.int64()), ("e", pa.int64()), ("s", pa.int32())])

    def run(batches):
        for b in batches:
            ids, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d", "e"))
            for i, _, data, offs in text_slices(b.column("text")):
                w = Words(data, offs)
                h = w.hashes()
                ok, g, pos = _anchors(h, w, window)
                if not len(ok):
                    continue
                row = w.row_of()
                at = np.flatnonzero(_runs(ok, pos, row))
                r = row[ok[at]]
                yield pa.RecordBatch.from_arrays([pa.array(signed(g[pos[at]])), pa.array(ids[i + r]), pa.array(own[i + r]), pa.array((ok[at] - w.first[r]).astype(np.int32))], schema=schema)

    return run


def _window_rows(window: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("d", pa.int64()), ("e", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for b in batches:
            ids, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d", "e"))
            marks = b.column("marks")
            for i, j, data, offs in text_slices(b.column("text")):
                w = Words(data, offs)
                h = w.hashes()
                ok, _, pos = _anchors(h, w, window)
                if not len(ok):
                    continue
                row = w.row_of()
                new = _runs(ok, pos, row)
                run_of = np.cumsum(new) - 1
                begin = ok[new]  # the word where each run starts
                part = marks.slice(i, j - i)
                vals = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lens = np.diff(part.offsets.to_numpy(zero_copy_only=False))
                r = np.repeat(np.arange(j - i), lens)
                copies = np.unique(r[vals < 0])
                hit = np.isin(begin, w.first[:-1][r[vals >= 0]] + vals[vals >= 0])
                if len(copies):
                    hit &= ~np.isin(row[begin], copies)
                at = ok[hit[run_of]]
                if not len(at):
                    continue
                k1, k2 = gram_hash(h, window, 22)[at], gram_hash(h, window, 23)[at]
                rr = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(signed(k1)), pa.array((k2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(ids[i + rr]), pa.array(own[i + rr]), pa.array((at - w.first[rr]).astype(np.int32))], schema=schema)

    return run


def parse(pos: np.ndarray, sd: np.ndarray, se: np.ndarray, sp: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy factors (start, length, ref doc, ref start) of a document, from its windows that stand earlier; (sd, se) name a reference text."""
    order = np.argsort(pos, kind="stable")
    pos, sd, se, sp = (x[order] for x in (pos, sd, se, sp))
    if len(pos) > 1:
        one = np.ones(len(pos), bool)
        one[1:] = pos[1:] != pos[:-1]
        pos, sd, se, sp = (x[one] for x in (pos, sd, se, sp))
    # a factor goes on while the next window is the next of the same reference run
    cut = np.ones(len(pos), bool)
    cut[1:] = (pos[1:] != pos[:-1] + 1) | (sd[1:] != sd[:-1]) | (se[1:] != se[:-1]) | (sp[1:] != sp[:-1] + 1)
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(pos)) - 1
    return [(int(pos[a]), int(pos[e] - pos[a]) + window, int(sd[a]), int(sp[a])) for a, e in zip(at, ends, strict=True)]


def _factor_rows(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("factors", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])))])

    def run(batches):
        for b in batches:
            late = b.column("late")
            for i, j, data, offs in text_slices(b.column("text")):
                w = Words(data, offs)
                raw = data.tobytes()
                out = {n: [] for n in schema.names}
                for r in range(j - i):
                    lo, hi = int(w.first[r]), int(w.first[r + 1])
                    n, factors = hi - lo, []
                    found = late[i + r]
                    if found.is_valid and len(found.values):
                        v = found.values
                        pos, sd, se, sp = (v.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "sd", "se", "sp"))
                        if pos.min() < 0:  # a copy of a whole text
                            if n >= window:
                                at = int(pos.argmin())
                                factors = [(0, n, int(sd[at]), 0)]
                        else:
                            factors = parse(pos, sd, se, sp, window)
                    keep = np.ones(n, bool)
                    for s, length, _, _ in factors:
                        keep[s : s + length] = False
                    words = raw[offs[r] : offs[r + 1]].split()
                    kept = words if not factors else [words[x] for x in np.flatnonzero(keep)]
                    out["doc_id"].append(b.column("doc_id")[i + r].as_py())
                    out["n_words"].append(n)
                    out["n_removed"].append(n - len(kept))
                    out["kept_text"].append(b" ".join(kept).decode())
                    out["factors"].append([dict(zip(("start", "length", "ref_doc", "ref_start"), f, strict=True)) for f in factors])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _digest_rows(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    rows = _factor_rows(window)

    def run(batches):
        for b in rows(batches):
            kept = b.column("kept_text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_removed"), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept])], schema=schema)

    return run


def _with_late(docs: DataFrame, window: int) -> DataFrame:
    """The rows with `late`: their windows that stand earlier. A document is a doc_id with a text (d, e)."""
    spark = docs.sparkSession
    n = tasks_for(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("d"), row_hash().alias("e"), F.col("text"))
    # whole copies: one item a document
    whole = docs.where("text is not null").select(F.xxhash64("text").alias("k1"), F.hash(F.reverse("text")).alias("k2"), "d", "e", F.lit(-1).cast("int").alias("pos"))
    copies = later_occurrences(whole, "op1_copies", n)
    anchors = docs.select("d", "e", "text").mapInArrow(_anchor_rows(window), "a long, d long, e long, s int")
    repeats = repeated_keys(anchors, "op1_anchors", n)
    release(spark)
    marks = repeats.unionByName(copies.select("d", "e", F.lit(-1).cast("int").alias("s"))).groupBy("d", "e").agg(F.collect_list("s").alias("marks"))
    windows = docs.select("d", "e", "text").join(marks, ["d", "e"]).select("d", "e", "text", "marks").mapInArrow(_window_rows(window), "k1 long, k2 int, d long, e long, pos int")
    late = later_occurrences(windows, "op1_windows", n)
    discard(repeats)
    release(spark)
    by_doc = late.unionByName(copies).groupBy("d", "e").agg(F.collect_list(F.struct("pos", "sd", "se", "sp")).alias("late"))
    return docs.join(by_doc, ["d", "e"], "left").select("doc_id", "text", "late")


def rlz_factors(docs: DataFrame, window: int = 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_text and its factors (word start and length, and where the reference has it)."""
    return _with_late(docs, window).mapInArrow(_factor_rows(window), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("factors", T.ArrayType(FACTOR))]))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _with_late(docs, 20).mapInArrow(_digest_rows(20), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS fd, min(doc_id * 10000000 + i) OVER (PARTITION BY k) AS first_at FROM g),
r AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM m WHERE first_at <> doc_id * 10000000 + i)),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
s AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.j) FILTER (WHERE r.j IS NULL) AS kept, count(r.j) AS gone FROM k LEFT JOIN r ON k.doc_id = r.doc_id AND k.j = r.j GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""
