"""Document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs are the lines of a text. A section starts at the first paragraph, after an empty one, and
at paragraphs whose digest is 0 modulo SECTION, so an edit moves section limits near it only. Digests
are SHA-256: of a paragraph its UTF-8 bytes, of a section its paragraphs' digests, of the root its
sections' digests. Under each paragraph hang leaves of about PIECE words, cut where a word's hash says so.

The fingerprint is the tree itself as a string: the root's digest, then the nodes in order, each as 6
bytes (5 of its digest, and what it is: a section, a paragraph, or a leaf of so many words). Whatever is
said of two texts is read from their two fingerprints: equal roots mean equal texts; where roots differ,
equal sections are passed over, then equal paragraphs in the others, then equal leaves in the others. The
likeness is twice the words under equal nodes over the words of both, and under 1 where roots differ.

The neighbour of a document comes from one range shuffle by doc_id: rows of a partition lie in order,
and what stands at the ends of partitions is joined in a second, small step (two rows a partition).

Defined cases: null and empty texts are the text '' (one empty paragraph); a null doc_id counts as
the largest; rows that share a doc_id, or have none, are ordered by a hash of the text, so they can lie
in any number of partitions; a table of one row is its own neighbour; an empty table gives no rows.
Different texts without words have likeness 0. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, doc_key, hash_spans, row_hash, staged, table, tasks_for

SECTION = 8
PIECE = 16
#: Kinds of nodes; a leaf has its number of words, MOST_WORDS at most.
SECTION_NODE, PARAGRAPH_NODE, MOST_WORDS = 255, 254, 200


def fingerprint(raw: bytes) -> str:
    """The tree of a text: root digest, a point, and the nodes in order in base 64."""
    sha = hashlib.sha256
    lines = raw.split(b"\n")
    digests = [sha(p).digest() for p in lines]
    empty, groups, fresh = sha(b"").digest(), [], True
    for d in digests:
        if fresh or d[0] % SECTION == 0:
            groups.append([])
        groups[-1].append(d)
        fresh = d == empty
    sections = [sha(b"".join(g)).digest() for g in groups]
    root = sha(b"".join(sections)).hexdigest()
    data = np.frombuffer(raw, np.uint8)
    w = Words(data, np.array([0, len(data)], np.int64))
    first_paragraph = np.cumsum([0] + [len(g) for g in groups[:-1]])
    n, m = len(lines), len(groups)
    if len(w.starts):
        at_line = np.searchsorted(np.flatnonzero(data == 10), w.starts)
        last = w.hashes() % np.uint64(PIECE) == 0
        last[:-1] |= at_line[1:] != at_line[:-1]
        last[-1] = True
        begin = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
        long = np.flatnonzero(np.diff(np.append(begin, len(last))) > MOST_WORDS)
        for b, e in zip(begin[long].tolist(), np.append(begin, len(last))[long + 1].tolist(), strict=True):
            last[b + MOST_WORDS - 1 : e - 1 : MOST_WORDS] = True
        at = np.flatnonzero(last)
        begin = np.concatenate(([0], at[:-1] + 1))
        leaf, counts, paragraph = hash_spans(data, w.starts[begin], w.ends[at]), at - begin + 1, at_line[begin]
    else:
        leaf, counts, paragraph = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    # nodes in order: a section before its first paragraph, a paragraph before its leaves
    per = np.bincount(paragraph, minlength=n) if len(paragraph) else np.zeros(n, np.int64)
    heads = np.zeros(n, np.int64)
    heads[first_paragraph] = 1
    before = np.cumsum(per + 1 + heads) - per - 1  # place of each paragraph's node
    out = np.zeros((m + n + len(leaf), 6), np.uint8)
    out[before, :5] = np.frombuffer(b"".join([d[:5] for d in digests]), np.uint8).reshape(n, 5)
    out[before, 5] = PARAGRAPH_NODE
    own = before[first_paragraph] - 1
    out[own, :5] = np.frombuffer(b"".join([d[:5] for d in sections]), np.uint8).reshape(m, 5)
    out[own, 5] = SECTION_NODE
    if len(leaf):
        start = np.cumsum(per) - per
        place = before[paragraph] + 1 + np.arange(len(leaf)) - start[paragraph]
        out[place, :5] = leaf.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]
        out[place, 5] = counts
    return root + "." + base64.b64encode(out.tobytes()).decode()


class Tree:
    """A fingerprint, read: digests of sections, paragraphs and leaves, and which node each hangs under."""

    __slots__ = ("in_paragraph", "in_section", "leaves", "paragraphs", "root", "sections", "total", "words")

    def __init__(self, fp: str):
        self.root, nodes = fp.split(".")
        rows = np.frombuffer(base64.b64decode(nodes), np.uint8).reshape(-1, 6)
        kind = rows[:, 5]
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :5] = rows[:, :5]
        digest = wide.view("<u8")[:, 0].astype(np.int64)
        section, paragraph = kind == SECTION_NODE, kind == PARAGRAPH_NODE
        leaf = ~(section | paragraph)
        self.sections, self.paragraphs, self.leaves = digest[section], digest[paragraph], digest[leaf]
        self.in_section = np.cumsum(section)[paragraph] - 1
        self.in_paragraph = np.cumsum(paragraph)[leaf] - 1
        self.words = kind[leaf].astype(np.int64)
        self.total = int(self.words.sum())


def _paired(a: np.ndarray, b: np.ndarray, weigh: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which of a and of b have a partner: equal numbers are paired one to one."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool), np.zeros(len(b), bool)
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    value = both[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    group = np.cumsum(new) - 1
    mine = order < len(a)
    n_a, n_b = np.bincount(group, weights=mine), np.bincount(group, weights=~mine)
    pairs = np.minimum(n_a, n_b)[group]
    start = np.flatnonzero(new)[group]
    nth = np.arange(len(value)) - start  # a's stand before b's in each group
    hit = np.zeros(len(both), bool)
    hit[order] = np.where(mine, nth < pairs, nth - n_a[group] < pairs)
    return hit[: len(a)], hit[len(a) :]


def compare(a: Tree, b: Tree) -> tuple[float, np.ndarray, np.ndarray]:
    """(likeness, paragraphs of a that differ, paragraphs of b that differ), from the root down."""
    if a.root == b.root:
        return 1.0, np.empty(0, np.int64), np.empty(0, np.int64)
    section_a, section_b = _paired(a.sections, b.sections)
    open_a, open_b = np.flatnonzero(~section_a[a.in_section]), np.flatnonzero(~section_b[b.in_section])
    same_a, same_b = _paired(a.paragraphs[open_a], b.paragraphs[open_b])
    open_a, open_b = open_a[~same_a], open_b[~same_b]
    if not a.total or not b.total:
        return 0.0, open_a, open_b
    left_a, left_b = (np.isin(t.in_paragraph, o) for t, o in ((a, open_a), (b, open_b)))
    leaf_a, leaf_b = _paired(a.leaves[left_a], b.leaves[left_b])
    alone = int(a.words[left_a][~leaf_a].sum() + b.words[left_b][~leaf_b].sum())
    whole = a.total + b.total
    return min((whole - alone) / whole, 1 - 1 / (whole + 1)), open_a, open_b


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of both fingerprints' words under nodes that they have in common."""
    return compare(Tree(a), Tree(b))[0]


def _spans(numbers: np.ndarray) -> list[tuple[int, int]]:
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) > 1)
    return list(zip(numbers[np.concatenate(([0], cut + 1))].tolist(), (numbers[np.concatenate((cut, [len(numbers) - 1]))] + 1).tolist(), strict=True))


def locate_edits(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(first, end) of the runs of paragraphs of a, and of b, that the other hasn't, from the two fingerprints."""
    _, x, y = compare(Tree(a), Tree(b))
    return _spans(x), _spans(y)


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as much of the start of the next."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


_ROW = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_edited", pa.int64()), ("first_edited", pa.int64()), ("text", pa.string())])
_ROW_SQL = "kind int, pid int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edited long, first_edited long, text string"


def _row(doc_id, text: str, fp: str, tree: Tree, after: str, after_tree: Tree) -> tuple:
    """n_edited paragraphs of the text differ from the edited text's, the first is first_edited (null: none)."""
    new = edited(text, after).encode()
    new_fp = fingerprint(new)
    near, changed, _ = compare(tree, Tree(new_fp))
    return (0, 0, doc_id, len(text), hashlib.sha256(new).hexdigest(), fp, new_fp, near, compare(tree, after_tree)[0], len(changed), int(changed[0]) if len(changed) else None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)], schema=_ROW)


def _fingerprint_rows(batches):
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    held, rows, size = None, [], 0
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        for i in range(b.num_rows):
            text = texts[i].as_py() or ""
            fp = fingerprint(text.encode())
            tree = Tree(fp)
            doc_id = ids[i].as_py()
            if held is None:
                rows.append((1, pid, doc_id, *[None] * 8, text))
            else:
                rows.append(_row(*held, text, tree))
            held = (doc_id, text, fp, tree)
            size += len(text)
            if size > SLICE_BYTES:
                yield _batch(rows)
                rows, size = [], 0
    if held is not None:
        rows.append((2, pid, held[0], *[None] * 8, held[1]))
    if rows:
        yield _batch(rows)


def _joined_rows(batches):
    for b in batches:
        rows = []
        for r in b.to_pylist():
            after, text = r["after"] or "", r["text"] or ""
            fp = fingerprint(text.encode())
            rows.append(_row(r["doc_id"], text, fp, Tree(fp), after, Tree(fingerprint(after.encode()))))
        if rows:
            yield _batch(rows)


def fingerprint_chain(docs: DataFrame) -> DataFrame:
    """One row a document: its fingerprint, that of the text edited with the next document's, and likenesses."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("_k"), row_hash().alias("_e"), "text")
    order = [F.col("_k").desc(), F.col("_e").asc()]
    ordered = keyed.repartitionByRange(tasks_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    found = staged(ordered.mapInArrow(_fingerprint_rows, _ROW_SQL), "op3_rows")
    pids = sorted(r.pid for r in found.where("kind = 1").select("pid").collect())  # a number a partition
    done = found.where("kind = 0").drop("kind", "pid", "text")
    if not pids:
        return done
    following = spark.createDataFrame([(p, pids[(i + 1) % len(pids)]) for i, p in enumerate(pids)], "pid int, next int")
    tails = found.where("kind = 2").join(following, "pid").select("doc_id", "text", "next")
    heads = found.where("kind = 1").select(F.col("pid").alias("next"), F.col("text").alias("after"))
    ends = tails.hint("merge").join(heads, "next").select("doc_id", "text", "after")
    return done.unionByName(ends.mapInArrow(_joined_rows, _ROW_SQL).drop("kind", "pid", "text"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(table(spark, sf_dir, "documents"))
