"""What the operators of this subpackage share: staged tables, word kernels, sorted runs."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A null doc_id sorts after every other.
NULL_KEY = (1 << 63) - 1
#: Bytes of text that the array kernels take at a time.
SLICE_BYTES = 1 << 20
#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 22


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is made only where none is named and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="staged_")
        _OWN[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so a Python worker's memory doesn't hang on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer splits than there are cores, as a single small file is, is dealt over all of them."""
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() * 2 > cores else rows.repartition(cores)


def tasks_for(df: DataFrame, per: int = 1) -> int:
    """How many tasks a shuffle of about the input's size needs: the session's number, or more where the scan has more splits."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), per * df.rdd.getNumPartitions())


def doc_key(col="doc_id"):
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_KEY))


# ---------------------------------------------------------------- array kernels

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int, start: int = 0) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(start, start + n, dtype=np.uint64) + np.uint64(1)) * _GOLD + np.uint64(seed * 0x1F123BB5 + 7))


_BYTE = stream(256, 11)
_PLACE = stream(1 << 12, 12) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = stream(1 << (n - 1).bit_length(), 12) | np.uint64(1)
    return _PLACE[:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each span of bytes; spans are in order and not empty."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lens = ends - starts
    total = np.cumsum(lens)
    if total[-1] > HASH_BYTES and len(lens) > 1:  # temporary arrays of a very long text stay bounded
        cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(HASH_BYTES, total[-1], HASH_BYTES)), [len(lens)])))
        return np.concatenate([hash_spans(data, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    first = np.concatenate(([0], total[:-1]))
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    val = _BYTE[data[at + np.repeat(starts, lens)]] * places(int(lens.max()))[at]
    return mix(np.add.reduceat(val, first) + lens.astype(np.uint64) * _GOLD)


class Words:
    """The words of some consecutive rows: byte spans, 64-bit hashes and the row of each word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= _SPACE[data[:-1]] | edge[1:-1]
        end[:-1] &= _SPACE[data[1:]] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        #: Words of row i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows of whole texts; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return
    if pa.types.is_large_string(col.type):
        offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    else:
        offs = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def gram_hash(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k consecutive values (windows run across rows; mask those out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m = stream(1, seed)[0] | np.uint64(1)
    g = mix(h[:n] + m)
    for q in range(1, k):
        g = g * m + h[q : n + q]
    return mix(g ^ np.uint64(seed))


def inside(first: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Mask over all starts (one a word, less k - 1): the k words from there are of one row."""
    n = int(counts.sum()) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], counts)[:n] - np.arange(n)
    return left >= k


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


# ---------------------------------------------------------------- sorted runs

_PLACE_FIELDS = [("d", T.LongType()), ("e", T.LongType()), ("pos", T.IntegerType()), ("sd", T.LongType()), ("se", T.LongType()), ("sp", T.IntegerType())]
LATER = T.StructType([T.StructField(n, t) for n, t in [*_PLACE_FIELDS, ("kind", T.IntegerType()), ("pid", T.IntegerType()), ("k1", T.LongType()), ("k2", T.IntegerType())]])
_LATER_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32()) for f in LATER.fields])


def row_hash(text: str = "text"):
    """What tells rows of one doc_id apart: a hash of the text, null as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _later(batches):
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    cur = None  # key of the open group, its first place, and the last place seen
    head = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        k1, k2, d, e, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "d", "e", "pos"))
        new = np.ones(n, bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        again = np.zeros(n, bool)  # the place of the row before, as repeated rows have it
        again[1:] = ~new[1:] & (d[1:] == d[:-1]) & (e[1:] == e[:-1]) & (pos[1:] == pos[:-1])
        if cur is not None:
            new[0] = (k1[0], k2[0]) != cur[:2]
            again[0] = not new[0] and (d[0], e[0], pos[0]) == cur[5:]
        group = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = (0, 0, 0) if cur is None else cur[2:5]
        sd, se, sp = (np.where(group < 0, x, y[group]) for x, y in zip(first, (d, e, pos), strict=True))
        if head is None:
            head = (int(k1[0]), int(k2[0]), int(d[0]), int(e[0]), int(pos[0]))
        late = np.flatnonzero(((sd != d) | (se != e) | (sp != pos)) & ~again)
        if len(late):
            z = np.zeros(len(late), np.int32)
            places_ = [x[late] for x in (d, e)] + [pos[late].astype(np.int32)] + [x[late] for x in (sd, se)] + [sp[late].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*places_, z, z, z.astype(np.int64), z)], schema=_LATER_ARROW)
        cur = tuple(int(x[-1]) for x in (k1, k2, sd, se, sp, d, e, pos))
    if head is not None:  # what the neighbouring partitions must know
        rows = [(*head[2:], 0, 0, 0, 1, pid, *head[:2]), (0, 0, 0, *cur[2:5], 2, pid, *cur[:2])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _LATER_ARROW.types[i]) for i in range(10)], schema=_LATER_ARROW)


def later_occurrences(items: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Places (d, e, pos) whose key (k1, k2) also stands at an earlier place, with the first such place (sd, se, sp).

    items has k1 long, k2 int, and a place d long, e long, pos int; e tells rows of one d apart. One range
    shuffle by key and place, so a key that holds any share of the rows is dealt over several tasks; two
    rows a partition tell the driver where a group runs on into the next partition. Equal places never
    make each other later.
    """
    spark = items.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["k1", "k2", "d", "e", "pos"]
    ordered = items.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = staged(ordered.mapInArrow(_later, LATER), name)
    late = found.where("kind = 0").select("d", "e", "pos", "sd", "se", "sp")
    ends: dict[int, dict[int, tuple]] = {}
    for r in found.where("kind > 0").collect():  # two rows a partition
        ends.setdefault(r.pid, {})[r.kind] = r
    fixed, before = [], None
    for pid in sorted(ends):
        h, t = ends[pid][1], ends[pid][2]
        joined = before is not None and before[:2] == (h.k1, h.k2)
        if joined and before[2:] != (h.d, h.e, h.pos):
            fixed.append((h.d, h.e, h.pos, *before[2:]))
        # a group that fills the whole partition keeps its first place
        before = before if joined and (t.k1, t.k2) == (h.k1, h.k2) else (t.k1, t.k2, t.sd, t.se, t.sp)
    out = late
    if fixed:  # a row a partition at most; what points at a partition's first row points at the group's
        moved = spark.createDataFrame(fixed, "_d long, _e long, _p int, _sd long, _se long, _sp int")
        here = (F.col("sd") == F.col("_d")) & (F.col("se") == F.col("_e")) & (F.col("sp") == F.col("_p"))
        late = late.join(F.broadcast(moved), here, "left").select("d", "e", "pos", *(F.coalesce(f"_{c}", c).alias(c) for c in ("sd", "se", "sp")))
        out = late.unionByName(spark.createDataFrame(fixed, late.schema))
    out._staged_path = found._staged_path
    return out


REPEATED = T.StructType([T.StructField(n, t) for n, t in (("d", T.LongType()), ("e", T.LongType()), ("s", T.IntegerType()), ("kind", T.IntegerType()), ("pid", T.IntegerType()), ("a", T.LongType()))])
_REPEATED_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32()) for f in REPEATED.fields])


def _repeated(batches):
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    prev = None  # the last row so far: (a, d, e, s, already known to be repeated)
    head = None  # the first key, and whether its group has a second row here
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        a, d, e, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "d", "e", "s"))
        if prev is not None:
            a, d, e, s = (np.concatenate(([x], y)) for x, y in zip(prev, (a, d, e, s), strict=False))
        same = a[1:] == a[:-1]
        hit = np.zeros(len(a), bool)
        hit[1:] |= same
        hit[:-1] |= same
        known = prev is not None and prev[4]
        if prev is None:
            head = [int(a[0]), int(d[0]), int(e[0]), int(s[0]), False]
        if not head[4] and hit[0] and [int(x[0]) for x in (a, d, e, s)] == head[:4]:
            head[4] = True
        out = hit.copy()
        out[1:] &= ~(same & (d[1:] == d[:-1]) & (e[1:] == e[:-1]) & (s[1:] == s[:-1]))  # once for repeated rows
        if known:
            out[0] = False  # was given before
        at = np.flatnonzero(out)
        if len(at):
            z = np.zeros(len(at), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[at], e[at], s[at].astype(np.int32), z, z, z.astype(np.int64))], schema=_REPEATED_ARROW)
        prev = (*(int(x[-1]) for x in (a, d, e, s)), bool(hit[-1] or (known and len(a) == 1)))
    if prev is not None:
        # kind 1: first row, kind 2: last row; + 2 if already given as repeated
        rows = [(*head[1:4], 3 if head[4] else 1, pid, head[0]), (*prev[1:4], 4 if prev[4] else 2, pid, prev[0])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _REPEATED_ARROW.types[i]) for i in range(6)], schema=_REPEATED_ARROW)


def repeated_keys(items: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Rows (d, e, s) whose key a stands in two rows or more, once each; the same skew-free shuffle."""
    spark = items.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = items.select("a", "d", "e", "s").repartitionByRange(n, "a", "d", "e", "s").sortWithinPartitions("a", "d", "e", "s")
    found = staged(ordered.mapInArrow(_repeated, REPEATED), name)
    out = found.where("kind = 0").select("d", "e", "s")
    ends: dict[int, dict[int, tuple]] = {}
    for r in found.where("kind > 0").collect():  # two rows a partition
        ends.setdefault(r.pid, {})[1 if r.kind in (1, 3) else 2] = r
    fixed, before = set(), None
    for pid in sorted(ends):
        h, t = ends[pid][1], ends[pid][2]
        if before is not None and before.a == h.a:
            fixed |= {(r.d, r.e, r.s) for r in (before, h) if r.kind < 3}
        before = t
    if fixed:
        out = out.unionByName(spark.createDataFrame(sorted(fixed), out.schema))
    out._staged_path = found._staged_path
    return out
