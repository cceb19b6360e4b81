"""MinHash near-dedup by improved consistent weighted sampling.

A text is a weighted set of its shingles (SHINGLE words; all words if it has fewer). The weight is TF-IDF:
how often the shingle stands in the text times its IDF. An exact table of the document frequency of
every shingle would be several times the input, so a shingle's IDF is estimated from its words': their
document frequencies are counted over all texts in a hashed table of fixed size, and the weight is
1 + mean(idf of its words) / log(1 + number of texts), between 1 and 2 (kept to 1/255).

Improved consistent weighted sampling draws BANDS * ROWS samples a text; texts that agree in all
samples of a band share a bucket and are candidates (a pair at 0.8 is missed with a chance of 2e-3).
Every pair of a bucket that isn't known to be of one class is verified by weighted Jaccard similarity,
but pairs are never listed. First each text is compared with the first of its bucket, then with a few
leaders of it; what links is one class. Texts of buckets that still hold two classes are sampled anew,
in more and finer bands, so that unlike texts that met by a common passage part (a pair at 0.8 is missed
with a chance of 6e-4 here). Buckets of one class are done; in the others some texts outside the
bucket's largest class are leaders that all are compared with, and then are done with the bucket;
rounds go on, each with more leaders, until no bucket has two classes. A bucket's texts are dealt over
tasks of about GROUP_ROWS texts and at most LEADERS leaders. Components of the links are the classes.

Nodes are 128-bit fingerprints of the words, so copies of one text (equal words) take part once.

Defined cases: null and empty texts, and texts without words, are classes of their own and all stay;
different texts under one doc_id, or none, are documents of their own; rows equal in doc_id and text
are copies; a class is named by its least doc_id (by a negative number from its text where it has none);
an empty table gives no rows; extra columns are ignored by `near_classes` and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import NULL_KEY, WORD, Words, discard, doc_key, gram_hash, later_occurrences, mix, release, row_hash, signed, staged, stream, table, tasks_for, text_slices
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
FINE_BANDS, FINE_ROWS = 40, 8
DF_BITS = 18
#: Texts that a group of a bucket holds, about, and leaders that they are compared with, at most.
GROUP_ROWS, LEADERS = 256, 32
#: Leaders of a bucket in the round after that of first texts, and in the first round of finer bands; how many times more each further round takes.
FEW_LEADERS, FIRST_LEADERS, GROWTH = 8, 32, 16
#: Buckets of more than one group are broadcast up to this number of them, else joined.
MOST_HOT = 50_000

_STEPS = 1 << 16


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1)."""
    x = np.concatenate((np.linspace(0, 1, 20_000) ** 2 * 2, np.linspace(2, 40, 60_000)[1:]))
    cdf = 1 - (1 + x) * np.exp(-x)
    return np.interp((np.arange(_STEPS) + 0.5) / _STEPS, cdf, x)


_GAMMA = _gamma_table()
_LOG_GAMMA = np.log(_GAMMA)


class Shingles:
    """The different shingles of some rows: row, 64-bit hash, count and weight, by row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, idf: np.ndarray):
        w = self.words = Words(data, offs)
        h = w.hashes()
        n = len(w.counts)
        if not len(h):
            self.row, self.hash, self.count, self.idf = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.float32)
            return
        word_row = w.row_of()
        rare = idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)].astype(np.float64)
        total = np.concatenate(([0.0], np.cumsum(rare)))
        rows, hashes, weights = [], [], []
        if len(h) >= SHINGLE:
            g = gram_hash(h, SHINGLE, 31)
            left = np.repeat(w.first[1:], w.counts)[: len(g)] - np.arange(len(g))
            ok = np.flatnonzero(left >= SHINGLE)
            rows.append(word_row[ok])
            hashes.append(g[ok])
            weights.append((total[ok + SHINGLE] - total[ok]) / SHINGLE)
        short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
        if len(short):
            lo, hi = w.first[short], w.first[short + 1]
            with np.errstate(over="ignore"):
                whole = np.add.reduceat(mix(h * (2 * (np.arange(len(h)) - w.first[word_row]).astype(np.uint64) + np.uint64(1))), lo) if len(lo) == n else np.array([mix(h[a:b] * (2 * np.arange(b - a, dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64) for a, b in zip(lo, hi, strict=True)], np.uint64)
            rows.append(short)
            hashes.append(mix(whole))
            weights.append((total[hi] - total[lo]) / (hi - lo))
        row, sh, weight = np.concatenate(rows), np.concatenate(hashes), np.concatenate(weights)
        order = np.argsort(sh, kind="stable")
        order = order[np.argsort(row[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
        row, sh, weight = row[order], sh[order], weight[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])
        at = np.flatnonzero(new)
        self.row, self.hash, self.count = row[at], sh[at], np.diff(np.append(at, len(row)))
        #: in 255ths above 1
        self.idf = np.rint(np.clip(weight[at], 0, 1) * 255).astype(np.uint8)


def signatures(s: Shingles, n: int, k: int) -> np.ndarray:
    """n x k hashes of the consistent samples of some rows (0 where a row has no shingle)."""
    out = np.zeros((n, k), np.uint64)
    if not len(s.row):
        return out
    log_w = np.log(s.count * (1 + s.idf / 255.0))
    first = np.flatnonzero(np.concatenate(([True], s.row[1:] != s.row[:-1])))
    rows = s.row[first]
    lens = np.diff(np.append(first, len(s.row)))
    seeds = stream(k, 33)
    low = np.uint64(_STEPS - 1)
    for j in range(k):
        bits = mix(s.hash ^ seeds[j])
        r = _GAMMA[(bits & low).astype(np.int64)]
        log_c = _LOG_GAMMA[((bits >> np.uint64(16)) & low).astype(np.int64)]
        beta = (bits >> np.uint64(32)).astype(np.float64) * (1.0 / (1 << 32))
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta + 1.0)
        best = np.minimum.reduceat(log_a, first)
        hit = np.flatnonzero(log_a == np.repeat(best, lens))
        own = np.searchsorted(hit, first)
        at = hit[own]
        out[rows, j] = mix(s.hash[at] + (t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def _df_rows(batches):
    counts, docs = np.zeros(1 << DF_BITS, np.int64), 0
    for b in batches:
        for _, j, data, offs in text_slices(b.column("text")):
            w = Words(data, offs)
            docs += int((w.counts > 0).sum())
            both = np.unique((w.row_of() << DF_BITS) | (w.hashes() >> np.uint64(64 - DF_BITS)).astype(np.int64))
            counts += np.bincount(both & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
    at = np.flatnonzero(counts)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], docs))], names=["bucket", "df"])


def idf_table(docs: DataFrame) -> np.ndarray:
    """idf / log(1 + number of texts) of each bucket of words, 0 to 1."""
    rows = docs.select("text").mapInArrow(_df_rows, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()  # 2^DF_BITS rows at most
    bucket, df = rows.column("bucket").to_numpy(), rows.column("df").to_numpy()
    n = float(df[bucket < 0].sum()) if len(bucket) else 0.0
    counts = np.zeros(1 << DF_BITS)
    counts[bucket[bucket >= 0]] = df[bucket >= 0]
    top = math.log(1 + n) if n else 1.0
    return (np.clip(np.log((1 + n) / (1 + counts)), 0, None) / top).astype(np.float32)


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys of n x (bands * rows) samples."""
    sig = sig.reshape(len(sig), bands, rows)
    keys = stream(bands, 34)[None, :] + np.zeros((len(sig), 1), np.uint64)
    with np.errstate(over="ignore"):
        for q in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, q])
    return keys


def _sketch_rows(shared):
    names = ["d", "e", "f1", "f2", "n_words", "bands"]

    def run(batches):
        idf = shared.value
        for b in batches:
            for i, j, data, offs in text_slices(b.column("text")):
                s = Shingles(data, offs, idf)
                n = j - i
                keys = _band_keys(signatures(s, n, BANDS * ROWS), BANDS, ROWS)
                raw = data.tobytes()
                whole = np.frombuffer(b"".join(hashlib.blake2b(b" ".join(raw[offs[r] : offs[r + 1]].split()), digest_size=16).digest() for r in range(n)), np.int64).reshape(n, 2)
                own = [b.column(c).slice(i, n) for c in ("d", "e")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()), pa.array(s.words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(signed(keys.reshape(-1))))], names=names)

    return run


def _token_rows(shared):
    def run(batches):
        idf = shared.value
        for b in batches:
            for i, j, data, offs in text_slices(b.column("text")):
                s = Shingles(data, offs, idf)
                cut = np.searchsorted(s.row, np.arange(j - i + 1))
                tokens, weights = [], []
                for r in range(j - i):
                    lo, hi = cut[r], cut[r + 1]
                    h, c, w = s.hash[lo:hi], s.count[lo:hi], s.idf[lo:hi]
                    if len(c) and c.max() > 1:  # a shingle that stands n times makes n tokens
                        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                        with np.errstate(over="ignore"):
                            h = mix(np.repeat(h, c) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        w = np.repeat(w, c)
                    else:
                        h = mix(h)
                    # two tokens of a text that share 32 bits count as one
                    kept, at = np.unique((h >> np.uint64(32)).astype(np.uint32), return_index=True)
                    tokens.append(kept.tobytes())
                    weights.append(w[at].tobytes())
                yield pa.RecordBatch.from_arrays([b.column("fp").slice(i, j - i), pa.array(tokens, pa.binary()), pa.array(weights, pa.binary())], names=["fp", "tokens", "weights"])

    return run


class Tokens:
    """Texts given by tokens and weights, as `signatures` takes shingles."""

    def __init__(self, tokens: list[bytes], weights: list[bytes]):
        sizes = np.array([len(w) for w in weights], np.int64)
        self.row = np.repeat(np.arange(len(weights)), sizes)
        self.hash = mix(np.frombuffer(b"".join(tokens), np.uint32).astype(np.uint64) + np.uint64(1))
        self.idf = np.frombuffer(b"".join(weights), np.uint8)
        self.count = np.ones(len(self.hash), np.int64)


def _fine_rows(batches):
    for b in batches:
        n = b.num_rows
        for i in range(0, n, 50):
            part = b.slice(i, min(50, n - i))
            fps = part.column("fp").to_pylist()
            keys = _band_keys(signatures(Tokens(part.column("tokens").to_pylist(), part.column("weights").to_pylist()), len(fps), FINE_BANDS * FINE_ROWS), FINE_BANDS, FINE_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array([f for f in fps for _ in range(FINE_BANDS)])], names=["k", "fp"])


class Leader:
    """A text that others are compared with."""

    __slots__ = ("fp", "label", "tokens", "total")

    def __init__(self, fp: str, label: str, tokens: np.ndarray, total: float):
        self.fp, self.label, self.tokens, self.total = fp, label, tokens, total


class Batch:
    """Some texts of one group: sorted tokens one after another, with their weights."""

    def __init__(self, fps: list[str], labels: list[str], tokens: list[bytes], weights: list[bytes]):
        self.fps, self.labels = fps, labels
        self.sizes = np.array([len(w) for w in weights], np.int64)
        self.tokens = np.frombuffer(b"".join(tokens), np.uint32)
        self.weights = 1 + np.frombuffer(b"".join(weights), np.uint8) / 255.0
        self.row = np.repeat(np.arange(len(fps)), self.sizes)
        self.totals = np.bincount(self.row, weights=self.weights, minlength=len(fps))

    def alike(self, leader: Leader, similarity: float = SIMILARITY) -> np.ndarray:
        """Which texts, of another class than the leader's, are similar enough."""
        floor = similarity - 1e-5
        wanted = np.array([x != leader.label for x in self.labels], bool)
        wanted &= np.minimum(self.totals, leader.total) >= floor * np.maximum(self.totals, leader.total)
        if not wanted.any() or not len(leader.tokens):
            return np.zeros(len(self.fps), bool)
        pick = wanted[self.row] if wanted.mean() < 0.5 else slice(None)
        tokens, weights, row = self.tokens[pick], self.weights[pick], self.row[pick]
        at = np.searchsorted(leader.tokens, tokens)
        at[at == len(leader.tokens)] = 0
        hit = leader.tokens[at] == tokens
        common = np.bincount(row[hit], weights=weights[hit], minlength=len(self.fps))
        return wanted & (common >= floor * (self.totals + leader.total - common))


def group_links(leaders: list[Leader], batch: Batch, similarity: float = SIMILARITY) -> set[tuple[str, str]]:
    """The pairs of classes that similar texts join: those of each text and its first leader, and of leaders that have a text in common."""
    mine: list[int | None] = [None] * len(batch.fps)
    out = set()
    for n, leader in enumerate(leaders):
        for r in np.flatnonzero(batch.alike(leader, similarity)).tolist():
            if mine[r] is None:
                mine[r] = n
                out.add((batch.labels[r], leader.label))
            else:
                out.add((leaders[mine[r]].label, leader.label))
    return {x for x in out if x[0] != x[1]}


def _verify_rows(batches):
    key, leaders = None, []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        groups = list(zip(*(b.column(c).to_pylist() for c in ("g", "salt", "block", "other")), strict=True))
        fps, labels, tokens, weights = (b.column(c).to_pylist() for c in ("fp", "label", "tokens", "weights"))
        links, i = set(), 0
        while i < n:
            j = i + 1
            while j < n and groups[j] == groups[i]:
                j += 1
            if groups[i][:3] != key:
                key, leaders = groups[i][:3], []
            part = Batch(fps[i:j], labels[i:j], tokens[i:j], weights[i:j])
            if groups[i][3] == 0:
                ends = np.cumsum(part.sizes)
                leaders += [Leader(part.fps[r], part.labels[r], part.tokens[ends[r] - part.sizes[r] : ends[r]], part.totals[r]) for r in range(j - i)]
            else:
                links |= group_links(leaders, part)
            i = j
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*sorted(links), strict=True)], names=["a", "b"])


def _node(a: str, b: str):
    """A fingerprint as a string whose order is that of its two halves."""
    return F.concat(*[F.lpad(F.hex(F.col(c).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") for c in (a, b)])


def _verified(groups: DataFrame, tokens: DataFrame, n: int, name: str) -> DataFrame:
    """groups: g string, salt int, block int, other int (0: leader), fp, label. Staged links a, b between labels, which are nodes themselves."""
    keys = ["g", "salt", "block"]
    full = groups.join(tokens, "fp").select(*keys, "other", "fp", "label", "tokens", "weights")
    dealt = full.repartition(n, *keys) if n > int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")) else full.repartition(*keys)  # small ones are put together
    return staged(dealt.sortWithinPartitions(*keys, "other", "fp").mapInArrow(_verify_rows, "a string, b string"), name)


def _salted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows with `salts`, how many groups their key's rows make, and one row a key: key, salts."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts"))
    hot = sizes.where("salts > 1").withColumnRenamed(key, "_hot")
    bounded = hot.limit(MOST_HOT + 1).count() <= MOST_HOT
    out = rows.join(F.broadcast(hot) if bounded else hot, F.col(key) == F.col("_hot"), "left").drop("_hot")
    return out.withColumn("salts", F.coalesce("salts", F.lit(1))), sizes


def _first_links(pairs: DataFrame, tokens: DataFrame, n: int) -> DataFrame:
    """pairs: a, b. Each text against the first of its buckets."""
    salted, sizes = _salted(pairs, "b")
    rows = salted.select(F.col("b").alias("g"), F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.lit(1).alias("other"), F.col("a").alias("fp"))
    heads = sizes.select(F.col("b").alias("g"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("other"), F.col("b").alias("fp"))
    return _verified(rows.unionByName(heads).select("*", F.lit(0).alias("block"), F.col("fp").alias("label")), tokens, n, "op2_links")


def _mixed(items: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """items: k, fp. The items with their labels, and the buckets of two classes or more; None without any."""
    tagged = items.join(labels, F.col("fp") == F.col("node"), "left").select("k", "fp", F.coalesce("label", "fp").alias("label"))
    classes = tagged.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = staged(classes.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "label")).alias("top")).where("classes > 1").select(F.col("k").alias("_k"), "n", F.col("top.label").alias("largest"), (F.col("n") - F.col("top.n")).alias("rest")), "op2_mixed")
    if mixed.limit(1).count():
        return tagged, mixed
    discard(mixed)
    return None


def _round(tagged: DataFrame, mixed: DataFrame, tokens: DataFrame, most: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Links of the buckets' next leaders, and the items that are left."""
    rows = staged(tagged.join(mixed, F.col("k") == F.col("_k")).select("k", "fp", "label", "rest", (F.col("label") == F.col("largest")).alias("common"), F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("salts")), "op2_open")
    # texts of the largest class need be no leaders: the others are compared with them
    place = F.row_number().over(Window.partitionBy("k").orderBy("fp"))
    heads = staged(rows.where(~F.col("common")).withColumn("p", place).where(F.col("p") <= most).select("k", "fp", "label", "salts", F.floor((F.col("p") - 1) / LEADERS).cast("int").alias("block")), "op2_leaders")
    blocks = F.ceil(F.least(F.col("rest"), F.lit(most)) / LEADERS).cast("int")
    g = F.col("k").cast("string").alias("g")
    others = rows.select(g, F.pmod(F.xxhash64("fp"), "salts").cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("other"), "fp", "label")
    leaders = heads.select(g, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "block", F.lit(0).alias("other"), "fp", "label")
    links = _verified(others.unionByName(leaders), tokens, n, "op2_links")
    left = staged(rows.select("k", "fp").join(heads.select("k", "fp"), ["k", "fp"], "left_anti"), "op2_items")
    for x in (mixed, rows, heads):
        discard(x)
    return links, left


def _resolve(links: DataFrame, items: DataFrame, tokens: DataFrame, n: int) -> DataFrame:
    """node, label of all texts that have a link, from those of the first round on."""
    labels = components(links, "op2_classes")
    found = _mixed(items, labels)
    if found is None:
        return labels
    more, _ = _round(*found, tokens, FEW_LEADERS, n)
    links = links.unionByName(more)
    labels = components(links, "op2_classes")
    found = _mixed(items, labels)
    if found is None:
        return labels
    tagged, mixed = found
    texts = tagged.join(mixed, F.col("k") == F.col("_k")).select("fp").distinct()
    fine = tokens.join(texts, "fp", "left_semi").select("fp", "tokens", "weights").mapInArrow(_fine_rows, "k long, fp string")
    items, most = staged(fine, "op2_fine"), FIRST_LEADERS
    while (found := _mixed(items, labels)) is not None:
        more, items = _round(*found, tokens, most, n)
        links, most = links.unionByName(more), most * GROWTH
        labels = components(links, "op2_classes")
        release(links.sparkSession)
    return labels


def near_classes(docs: DataFrame) -> DataFrame:
    """One row a document (d, e: key of its doc_id and hash of its text) that isn't the first of its class: d, e, class_id."""
    spark = docs.sparkSession
    n = tasks_for(docs)
    texts = docs.select(doc_key().alias("d"), row_hash().alias("e"), F.col("text"))
    shared = spark.sparkContext.broadcast(idf_table(docs))  # 1 MB, whatever the input
    sketches = staged(texts.mapInArrow(_sketch_rows(shared), "d long, e long, f1 long, f2 long, n_words long, bands array<long>").where("n_words > 0"), "op2_sketches")
    firsts = staged(sketches.dropDuplicates(["f1", "f2"]).select("d", "e", "f1", "f2", "bands"), "op2_texts")
    buckets = firsts.select(F.explode("bands").alias("k1"), F.lit(0).alias("k2"), F.col("f1").alias("d"), F.col("f2").alias("e"), F.lit(0).alias("pos"))
    near = later_occurrences(buckets, "op2_buckets", n)
    pairs = staged(near.select(_node("d", "e").alias("a"), _node("sd", "se").alias("b")).distinct(), "op2_pairs")
    discard(near)
    members = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    known = staged(firsts.withColumn("fp", _node("f1", "f2")).join(members, "fp").select("fp", "d", "e", "bands"), "op2_members")
    discard(firsts)
    # one join strategy at every size: both sides by document
    own = texts.hint("merge").join(known.select("fp", "d", "e"), ["d", "e"]).select("fp", "text")
    tokens = staged(own.mapInArrow(_token_rows(shared), "fp string, tokens binary, weights binary").dropDuplicates(["fp"]), "op2_tokens")
    release(spark)
    links = _first_links(pairs, tokens, n)
    labels = _resolve(links, known.select(F.explode("bands").alias("k"), "fp"), tokens, n)
    discard(tokens)
    named = sketches.select("d", "e", _node("f1", "f2").alias("fp")).join(labels, F.col("fp") == F.col("node"), "left")
    key = F.coalesce("label", "fp")
    placed = later_occurrences(named.select(F.xxhash64(key).alias("k1"), F.hash(key).alias("k2"), "d", "e", F.lit(0).alias("pos")), "op2_placed", n)
    release(spark)
    return placed.select("d", "e", _class_name("sd", "se").alias("class_id")).distinct()


def _class_name(d: str, e: str):
    """The doc_id of a class's first document, or a negative number from its text."""
    return F.when(F.col(d) != NULL_KEY, F.col(d)).otherwise(-F.shiftrightunsigned(F.col(e), 1) - 1)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one document of each class, that of the least doc_id; rows without a word all stay."""
    dropped = staged(near_classes(docs).select(F.col("d").alias("__d"), F.col("e").alias("__e")), "op2_dropped")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # of rows equal in doc_id and text one stays; this is cut down in each task before the shuffle
    once = F.row_number().over(Window.partitionBy("__d", "__e").orderBy(*order))
    keyed = docs.where(worded).withColumns({"__d": doc_key(), "__e": row_hash()}).withColumn("__n", once).where("__n = 1")
    left = keyed.hint("merge").join(dropped, ["__d", "__e"], "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(~worded))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_classes(docs).select(F.col("d").alias("_d"), F.col("e").alias("_e"), "class_id")
    rows = docs.select("doc_id", doc_key().alias("d"), row_hash().alias("e"))
    found = rows.join(classes, (F.col("d") == F.col("_d")) & (F.col("e") == F.col("_e")), "left")
    return found.select("doc_id", F.coalesce("class_id", _class_name("d", "e")).alias("class_id"))
