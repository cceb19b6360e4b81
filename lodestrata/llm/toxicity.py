"""Toxicity: a counterfactual-regularised linear classifier.

Features are the hashed lower-case words that a text has and the first bytes of longer words (each
counts once). A logistic regression with an L1 and an L2 penalty is fitted on labelled rows whose
crc32(doc_id as text) mod 5 is not 0: a hashed sample of FIT_ROWS rows at most, whole texts. Features
whose share of toxic texts is within LEAST_Z deviations of the mean are left out, and of the others the
MOST_FEATURES that deviate most are kept. For each such text that names a group of IDENTITY_TERMS, the
term is swapped for the others of its kind, with all features that it brings, beginnings of words
included, and the squared change of the score (in logits) is penalised, so that naming one group and not
another does not change a score. The weight of the L1 penalty is chosen from L1_CHOICES by the loss on
one fold of the learning rows (mod 5 is 1), never on the held-out one.

Counts of features are reduced on the executors (a row a bucket at most); the driver gets FIT_ROWS rows
of kept features at most and trains in one array program; scoring takes one scan.

Defined cases: null and empty texts get the score of no words; a doc_id with several labels has the
largest; a doc_id that several rows share gives them all its label, and the sample still has FIT_ROWS
rows at most; without labels of both kinds every score is the share of toxic ones (0 if none); held_out
of a null doc_id is false; rows are independent; extra columns are kept by `score_toxicity`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, hash_spans, mix, row_hash, staged, table, text_slices

BITS = 18
BUCKETS = 1 << BITS
FIT_ROWS = 20_000
MOST_FEATURES = 20_000
#: Texts of the sample that a word must stand in.
LEAST_DF = 3
LEAST_Z = 2.0
#: Bytes of the beginnings of words that are features too.
PREFIXES = (5, 7)
L1_CHOICES = (2e-4, 5e-5)
L2, COUNTERFACTUAL, STEPS = 1e-5, 10.0, 400

#: Groups that are named in neutral sentences; terms of one row are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "transgender", "nonbinary"),
    ("woman", "man"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "arab", "indian", "chinese"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def word_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the different words of some lower-case rows."""
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    shift, both = np.uint64(64 - BITS), []
    for n, cut in enumerate((0, *PREFIXES)):
        at = np.flatnonzero(ends - starts > cut)
        to = ends[at] if not cut else starts[at] + cut
        h = hash_spans(data, starts[at], to)
        both.append(row[at] * BUCKETS + ((h if not cut else mix(h + np.uint64(n))) >> shift).astype(np.int64))
    both = np.unique(np.concatenate(both))
    return both >> BITS, both & (BUCKETS - 1)


def bucket_of(word: str) -> int:
    """The feature of a whole word."""
    raw = np.frombuffer(word.lower().encode(), np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0] >> np.uint64(64 - BITS))


def buckets_of(text: str) -> np.ndarray:
    """The features of a whole text."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return word_buckets(raw, np.array([0, len(raw)]))[1]


def _lower(col) -> pa.Array:
    return pc.utf8_lower(col)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("e", pa.int64()), ("toxic", pa.int32()), ("fold", pa.int32()), ("words", pa.binary())])
_FEATURES_SQL = "doc_id long, e long, toxic int, fold int, words binary"


def _feature_rows(batches):
    for b in batches:
        for i, j, data, offs in text_slices(_lower(b.column("text"))):
            row, bucket = word_buckets(data, offs)
            cut = np.searchsorted(row, np.arange(j - i + 1))
            words = [bucket[cut[r] : cut[r + 1]].astype(np.uint32).tobytes() for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in _FEATURES.names[:4]), pa.array(words, pa.binary())], schema=_FEATURES)


def _count_rows(batches):
    df, hits, rows, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0, 0
    for b in batches:
        for words, label in zip(b.column("words").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            at = np.frombuffer(words, np.uint32)
            df[at] += 1
            hits[at] += label
            rows, toxic = rows + 1, toxic + label
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], rows)), pa.array(np.append(hits[at], toxic))], names=["bucket", "df", "hits"])


def _kept_rows(shared):
    def run(batches):
        keep = shared.value
        for b in batches:
            words = [(x := np.frombuffer(w, np.uint32))[keep[x]].tobytes() for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in _FEATURES.names[:4]), pa.array(words, pa.binary())], schema=_FEATURES)

    return run


def telling(df: np.ndarray, hits: np.ndarray, n: int, share: float, terms) -> np.ndarray:
    """Mask of the buckets that are features: those that deviate, and all that identity terms bring."""
    z = np.abs(hits - df * share) / np.sqrt(np.maximum(df, 1) * share * (1 - share))
    z[df < LEAST_DF] = 0.0
    keep = z >= LEAST_Z
    if keep.sum() > MOST_FEATURES:
        keep &= z >= np.partition(z, -MOST_FEATURES)[-MOST_FEATURES]
    for g in terms:
        for term in g:
            keep[buckets_of(term)] = True
    return keep


class Model:
    """Weights of the buckets and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, total: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(total + self.bias)))


def _swaps(df: np.ndarray, n: int, terms, place: np.ndarray):
    """The changes of features by swaps: (number of the swap, column, sign) of each, and the weight of each swap."""
    swap, column, sign, weight = [], [], [], []
    for g in terms:
        own = {t: set(buckets_of(t).tolist()) for t in g}
        for a in g:
            here = df[bucket_of(a)]
            for b in g:
                if a != b and here:
                    for side, value in ((own[b] - own[a], 1.0), (own[a] - own[b], -1.0)):
                        for f in sorted(side):
                            swap.append(len(weight))
                            column.append(place[f])
                            sign.append(value)
                    weight.append(here / n / (len(g) - 1))
    return np.array(swap, int), np.array(column, int), np.array(sign), np.array(weight)


def train(rows: list[np.ndarray], toxic: np.ndarray, terms=IDENTITY_TERMS, l1: float = L1_CHOICES[-1]) -> Model:
    """Accelerated proximal gradient on the penalised logistic loss."""
    n = len(rows)
    share = float(toxic.mean()) if n else 0.0
    if not 0.0 < share < 1.0:
        return Model(np.zeros(BUCKETS), np.inf if share else -np.inf)
    df, hits = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r, label in zip(rows, toxic, strict=True):
        df[r] += 1
        if label:
            hits[r] += 1
    keep = telling(df, hits, n, share, terms)
    chosen = [r[keep[r]] for r in rows]
    bucket = np.concatenate(chosen).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in chosen])
    known = np.flatnonzero(keep)
    place = np.full(BUCKETS, -1)
    place[known] = np.arange(len(known))
    col = place[bucket]
    swap, changed, sign, c = _swaps(df, n, terms, place)
    m, k = len(known), len(c)
    # rare words would need many steps in raw scale: scale by the root of their share
    scale = 1.0 / np.sqrt(np.maximum(np.bincount(col, minlength=m), 1) / n)
    pull = sign * scale[changed] if k else np.empty(0)
    norm = 0.25 * (1 + np.bincount(row, weights=scale[col] ** 2, minlength=n).mean()) + (4 * COUNTERFACTUAL * float((c[swap] * pull**2).sum()) if k else 0.0)
    w, bias = np.zeros(m), float(np.log(share / (1 - share)))
    y, yb, t = w, bias, 1.0
    step = 64.0 / norm
    target = toxic.astype(float)

    def change(v):
        return np.bincount(swap, weights=pull * v[changed], minlength=k) if k else np.zeros(0)

    def loss(v, vb):
        z = np.bincount(row, weights=(v * scale)[col], minlength=n) + vb
        return z, float(np.mean(np.logaddexp(0, z) - target * z) + COUNTERFACTUAL * (c * change(v) ** 2).sum() + L2 * ((v * scale) ** 2).sum() / 2)

    for _ in range(STEPS):
        z, at = loss(y, yb)
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / n
        grad = scale * (np.bincount(col, weights=g[row], minlength=m) + L2 * y * scale)
        if k:
            grad = grad + np.bincount(changed, weights=(2 * COUNTERFACTUAL * c * change(y))[swap] * pull, minlength=m)
        gb = float(g.sum())
        while True:  # shorten the step until the quadratic bound holds
            u = y - step * grad
            new = np.sign(u) * np.maximum(np.abs(u) - step * l1 * scale, 0.0)
            nb = yb - step * gb
            move = new - y
            bound = at + float(grad @ move) + gb * (nb - yb) + (float(move @ move) + (nb - yb) ** 2) / (2 * step)
            if loss(new, nb)[1] <= bound + 1e-12 or step < 1e-9:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    weights = np.zeros(BUCKETS)
    weights[known] = w * scale
    return Model(weights, bias)


def choose_l1(rows: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, terms=IDENTITY_TERMS) -> float:
    """The choice with the least loss on the learning rows of fold 1, fitted on the others."""
    inner, own = np.flatnonzero(fold == 1), np.flatnonzero(fold != 1)
    if not len(inner) or not 0 < toxic[own].sum() < len(own):
        return L1_CHOICES[-1]
    losses = []
    for l1 in L1_CHOICES:
        model = train([rows[i] for i in own], toxic[own], terms, l1)
        z = np.array([model.weights[rows[i]].sum() for i in inner]) + model.bias
        losses.append(float(np.mean(np.logaddexp(0, z) - toxic[inner] * z)))
    return L1_CHOICES[int(np.argmin(losses))]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From labelled rows outside the held-out fold only."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5
    known = labels.where("doc_id is not null and toxic is not null").where(fold != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(10)), F.col("doc_id")]
    sample = known.orderBy(*order).limit(fit_rows)  # small enough to be broadcast: fit_rows rows at most
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("e"), "text")
    taken = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "e", "toxic", fold.cast("int").alias("fold"), "text")
    features = staged(taken.mapInArrow(_feature_rows, _FEATURES_SQL).orderBy(*order, "e").limit(fit_rows), "op10_features")
    counts = features.mapInArrow(_count_rows, "bucket int, df long, hits long").groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")).toArrow()  # BUCKETS rows at most
    bucket, df, hits = (counts.column(x).to_numpy() for x in ("bucket", "df", "hits"))
    n, n_toxic = int(df[bucket < 0].sum()), int(hits[bucket < 0].sum())
    if not 0 < n_toxic < n:
        return train([], np.empty(0)) if not n else train([np.empty(0, np.uint32)] * n, np.full(n, n_toxic > 0))
    full_df, full_hits = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    full_df[bucket[bucket >= 0]], full_hits[bucket[bucket >= 0]] = df[bucket >= 0], hits[bucket >= 0]
    shared = spark.sparkContext.broadcast(telling(full_df, full_hits, n, n_toxic / n, IDENTITY_TERMS))
    got = sorted(features.mapInArrow(_kept_rows(shared), _FEATURES_SQL).collect(), key=lambda r: (r.doc_id, r.e))  # fit_rows rows of MOST_FEATURES features at most
    rows, toxic, folds = [np.frombuffer(bytes(r.words), np.uint32) for r in got], np.array([r.toxic for r in got]), np.array([r.fold for r in got])
    discard(features)
    return train(rows, toxic, l1=choose_l1(rows, toxic, folds))


def _score_rows(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            total = np.zeros(b.num_rows)
            for i, j, data, offs in text_slices(_lower(b.column("text"))):
                row, bucket = word_buckets(data, offs)
                total[i:j] = np.bincount(row, weights=model.weights[bucket], minlength=j - i)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(total))], names=[*b.schema.names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with `score`, 0 to 1."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score_rows(shared), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
