"""Quality classifier by importance resampling.

Two generative models, bags of hashed n-grams with add-one smoothing, are fitted: the raw one on all
documents, the target one on labelled documents of quality 1 (a hashed sample of FIT_ROWS labelled rows
at most). N-grams are words and pairs of words, with those of their shapes (kind, case, length, whether
the word repeats the one before). A document's log weight is the sum over its n-grams of the log ratio
of target to raw, its own n-grams being left out of the counts of both, so documents of the fitting
sample and others are weighed alike. Gumbel noise from a hash of doc_id is added, and the k largest are kept: sampling
without replacement in proportion to the weights. Unless k is given it is the number of documents that
the target is expected to have among them: the sum of min(1, share * weight), where share is that of
quality 1 among the labels.

The k-th largest key is found by radix selection: four counts over 65536 bins at most, so nothing is
sorted or gathered. Models are summed per partition before the shuffle: BUCKETS rows a task at most.

Defined cases: null and empty texts have weight 0 (in logs); null and unmatched labels are ignored; a
doc_id with several labels has the largest; without any target row all is kept; rows that share doc_id
and text, and ties of the key, are kept or dropped together; extra columns are kept by `keep_target`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_KEY, hash_spans, mix, staged, table, text_slices

#: A quarter for each kind of n-gram. Few enough that no group of copies rules a bucket.
BITS = 14
BUCKETS = 1 << BITS
FIT_ROWS = 20_000
SEED = 7
SMOOTHING = 1.0
#: Weights are cut here, against overflow only: share is 1 / FIT_ROWS at least, so share * weight is far over 1 by then.
MOST_LOG = 700.0

_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 sign
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of some rows."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begin, end = kind > 0, kind > 0
    begin[1:] &= (kind[1:] != kind[:-1]) | edge[1:-1]
    end = end.copy()
    end[:-1] &= (kind[1:] != kind[:-1]) | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.searchsorted(offs, starts, "right") - 1
    h = hash_spans(data, starts, ends)
    mate = np.zeros(len(h), bool)
    mate[1:] = row[1:] == row[:-1]
    again = np.zeros(len(h), bool)
    again[1:] = mate[1:] & (h[1:] == h[:-1])
    sign = kind[starts] == 2
    lens = ends - starts
    shape = np.minimum(lens, 20) // 4 + 8 * _UPPER[data[starts]] + 16 * _UPPER[data[ends - 1]] + 32 * (lens > 1) + 64 * again
    shape = np.where(sign, h, mix(shape.astype(np.uint64)))
    with np.errstate(over="ignore"):
        before = np.concatenate(([np.uint64(0)], h[:-1]))
        shape_before = np.concatenate(([np.uint64(0)], shape[:-1]))
        grams = [mix(h + np.uint64(1)), mix(h * np.uint64(3) + before)[mate], mix(shape + np.uint64(2)), mix(shape * np.uint64(5) + shape_before)[mate]]
    rows = [row, row[mate], row, row[mate]]
    buckets = [(g >> np.uint64(66 - BITS)).astype(np.int64) + (n << (BITS - 2)) for n, g in enumerate(grams)]
    return np.concatenate(rows), np.concatenate(buckets)


def _count_rows(target: np.ndarray):
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64()), ("target_docs", pa.int64())])

    def run(batches):
        raw, aim, seen = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            ids = b.column("__d").to_numpy(zero_copy_only=False)
            wanted = np.isin(ids, target)
            seen += int(wanted.sum())
            for i, j, data, offs in text_slices(b.column("text")):
                row, bucket = features(data, offs)
                raw += np.bincount(bucket, minlength=BUCKETS)
                if wanted[i:j].any():
                    aim += np.bincount(bucket[wanted[i:j][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        if len(at):
            docs = np.zeros(len(at), np.int64)
            docs[0] = seen
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(aim[at]), pa.array(docs)], schema=schema)

    return run


class Model:
    """Counts of the n-gram buckets in raw and target text, the target's doc_ids and its share among labelled rows."""

    def __init__(self, raw: np.ndarray, aim: np.ndarray, target: np.ndarray, share: float, fitted: bool):
        self.raw, self.aim, self.target, self.share, self.fitted = raw, aim, target, share, fitted
        self.scale = aim.sum() / max(1.0, raw.sum())

    def log_ratios(self, row: np.ndarray, bucket: np.ndarray, sampled: np.ndarray) -> np.ndarray:
        """The log weight of each row: sampled says which rows are in the target's sample."""
        if not self.fitted:
            return np.zeros(len(sampled))
        both, own = np.unique(row * BUCKETS + bucket, return_counts=True)
        r, b = both // BUCKETS, both % BUCKETS
        aim = np.maximum(self.aim[b] - own * sampled[r], 0.0)
        expected = np.maximum(self.raw[b] - own, 0.0) * self.scale
        return np.bincount(r, weights=own * np.log((aim + SMOOTHING) / (expected + SMOOTHING)), minlength=len(sampled))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(fit_rows).collect()  # fit_rows rows at most
    target = np.array(sorted(r.doc_id for r in sample if r.quality == 1), np.int64)
    share = len(target) / len(sample) if sample else 1.0
    counts = _keyed(docs.select("doc_id", "text")).select("__d", "text").mapInArrow(_count_rows(target), "bucket int, raw long, target long, target_docs long")
    raw, aim, seen = np.zeros(BUCKETS), np.zeros(BUCKETS), 0
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"), F.sum("target_docs").alias("docs")).collect():  # BUCKETS rows at most
        raw[r.bucket] += r.raw
        aim[r.bucket] += r.target
        seen += r.docs
    return Model(raw, aim, target, share, bool(seen))


def gumbel(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        u = (mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _score_rows(model: Model, names: tuple[str, str]):
    def run(batches):
        for b in batches:
            ids = b.column("__d").to_numpy(zero_copy_only=False)
            total = np.zeros(b.num_rows)
            sampled = np.isin(ids, model.target)
            for i, j, data, offs in text_slices(b.column("text")):
                total[i:j] = model.log_ratios(*features(data, offs), sampled[i:j])
            key = _ordered_bits(total + gumbel(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(total), pa.array(key)], names=[*b.schema.names[:-1], *names])

    return run


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("log_ratio", "sample_key")) -> DataFrame:
    """The rows with the log weight and the key (Gumbel-perturbed, as an ordered integer); columns of those names are replaced."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType())])
    return _keyed(docs).mapInArrow(_score_rows(model, names), schema)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest integer of a column; None if there are fewer."""
    high = None
    for shift in (48, 32, 16, 0):
        part = keys if high is None else keys.where(F.shiftright(column, shift + 16) == high)
        bins = part.groupBy(F.shiftright(column, shift).alias("bin")).count().collect()  # 65536 rows at most
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if r["count"] >= k:
                high = r["bin"]
                break
            k -= r["count"]
        else:
            return None
    return high


def threshold(scored: DataFrame, model: Model, k: int | None = None) -> int | None:
    """The least key that is kept; None: all are. scored is a staged table."""
    if not model.fitted:
        return None
    if k is None:
        k = round(scored.agg(F.sum(F.least(F.lit(1.0), F.lit(model.share) * F.exp(F.least(F.col("log_ratio"), F.lit(MOST_LOG))))).alias("k")).first()["k"] or 0)
    if k <= 0:
        return (1 << 63) - 1
    return kth_largest(scored, "sample_key", k)


def keep_target(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows that the sample takes, with their own columns."""
    model = fit(docs, labels)
    least = threshold(staged(score(docs.select("doc_id", "text"), model).select("log_ratio", "sample_key"), "op7_scores"), model, k)
    if least is None:
        return docs
    return score(docs, model, ("__log_ratio", "__sample_key")).where(F.col("__sample_key") >= least).select(docs.columns)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = staged(score(docs, model).select("doc_id", "log_ratio", "sample_key"), "op7_scores")
    least = threshold(scored, model)
    return scored.select("doc_id", "log_ratio", (F.lit(True) if least is None else F.col("sample_key") >= least).alias("kept"))
