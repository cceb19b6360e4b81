"""SentencePiece encoding and decoding by streaming Viterbi.

The segmentation is the one whose pieces' scores have the largest sum (a piece that starts earlier wins
a tie). Characters go by one at a time; scores are held for the nodes that the longest piece can still
reach, backpointers for what isn't committed. When the backpointer paths of all open nodes meet at one
boundary, the ids up to it are given out and the lattice before it is dropped. Whether they meet is
looked at each time the open part has doubled, so the work is in proportion to the text; memory hangs on
the longest stretch without such a boundary, one backpointer a character (a text whose paths never meet
is one such stretch). Where no piece spans a boundary (before a run of word marks, and around a character
of no piece) paths always meet; the units between such boundaries are streamed once and kept in a bounded
cache.

Text becomes pieces as the library has it: a word mark for each space and one before the text; a
character without a piece becomes its UTF-8 bytes. A word mark that stands in the text itself is coded
as bytes, so decoding gives every text back exactly.

Defined cases: null gives null ids, an empty text no ids; rows are independent, so repeated rows, ties
and null doc_ids need no rule; extra columns are kept by `encode` and `decode`. The vocabulary is read
on the driver from the path given and sent to the executors; its size is fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

MARK = "▁"
#: Units that each of the cache's two generations holds.
CACHE = 300_000
#: Longer units are streamed each time they come.
KEPT = 64
#: Characters that are read at a time, and after which paths are first looked at.
STRIDE = 64
#: Score of a node that no path reaches.
LEAST = -math.inf
#: What a character without a piece costs beyond the least score.
UNKNOWN = 10.0


def default_path() -> str:
    """The path used where none is given: the 32k model of the tokenizer folder's package, if that is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte ids of a model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.out = {}, [0] * 256, []
        least = 0.0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.out.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                score = float(sp.get_score(i))
                self.pieces[piece] = (score, i)
                self.out.append(piece.replace(MARK, " ").encode())
                least = min(least, score)
        self.unknown = least - UNKNOWN
        self.longest = max(map(len, self.pieces), default=1)
        #: The pieces as a tree: character -> (what follows, score, id; -1 for what only begins a piece).
        self.tree: dict[str, list] = {}
        for p, (score, i) in self.pieces.items():
            here = self.tree
            for c in p[:-1]:
                here = here.setdefault(c, [{}, 0.0, -1])[0]
            here.setdefault(p[-1], [{}, 0.0, -1])[1:] = score, i
        #: No piece goes on with a word mark after another character, nor over a line feed.
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.pieces)

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if k != "_codec"}


def viterbi(chars: Iterable[str], v: Vocabulary) -> Iterator[int]:
    """Ids of a stream of characters (any iterable), given out as soon as no later character can change them."""
    tree, longest, unknown = v.tree, v.longest, v.unknown
    source = iter(chars)
    text = ""  # what is not committed
    start = 0  # place in the text of the next character whose pieces are to be tried
    best, back, ids = [0.0], [0], [0]  # a node's best score, the node before, the id between (-1: bytes)
    look, ended = STRIDE, False
    while True:
        if not ended and len(text) - start < longest:
            more = "".join(islice(source, STRIDE))
            ended = len(more) < STRIDE
            text += more
            best += [LEAST] * len(more)
            back += [0] * len(more)
            ids += [0] * len(more)
        n = len(text)
        stop = n if ended else n - longest + 1
        while start < stop:
            here, single, node, e = best[start], False, tree, start
            if here > LEAST:
                for c in text[start : start + longest]:
                    found = node.get(c)
                    if found is None:
                        break
                    e += 1
                    node, score, piece = found
                    if piece >= 0:
                        if e == start + 1:
                            single = True
                        if here + score > best[e]:
                            best[e], back[e], ids[e] = here + score, start, piece
                if not single and here + unknown > best[start + 1]:
                    best[start + 1], back[start + 1], ids[start + 1] = here + unknown, start, -1
            start += 1
        if ended:
            yield from _path(text, back, ids, n, v)
            return
        if start >= look:
            meet = _meeting(best, back, start, min(n, start + longest))
            if meet > 0:
                yield from _path(text, back, ids, meet, v)
                gone = best[meet]
                text, start = text[meet:], start - meet
                best, back, ids = [x - gone for x in best[meet:]], [max(0, x - meet) for x in back[meet:]], ids[meet:]
            look = max(STRIDE, 2 * start)


def _path(text: str, back: list[int], ids: list[int], node: int, v: Vocabulary) -> list[int]:
    """The ids from the start of the open part to a node."""
    out = []
    while node > 0:
        if ids[node] >= 0:
            out.append(ids[node])
        else:
            out.extend(v.bytes[b] for b in reversed(text[back[node] : node].encode()))
        node = back[node]
    out.reverse()
    return out


def _meeting(best: list[float], back: list[int], start: int, end: int) -> int:
    """The last boundary that the paths of all open nodes, start to end, go through; 0 if that is the beginning."""
    marked = bytearray(end + 1)
    n = 0
    for x in range(start, end + 1):
        if best[x] > LEAST:
            marked[x], n = 1, n + 1
    for x in range(end, 0, -1):
        if marked[x]:
            if n == 1 and x <= start:
                return x
            if not marked[back[x]]:
                marked[back[x]] = 1
            else:
                n -= 1
    return 0


class Codec:
    """Encodes whole texts; a cache of units keeps their ids as packed 32-bit numbers."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.units = re.compile(f"{MARK}+[^{MARK}\n\x00]*|\n|\x00|[^{MARK}\n\x00]+" if v.cuts else r"(?s).+")
        self.literal = np.array([v.bytes[b] for b in MARK.encode()], np.int32).tobytes()
        codec = self

        class Cache(dict):
            old: dict = {}  # the generation before; what is met again moves on

            def __missing__(self, unit):
                out = self.old.get(unit)
                if out is None:
                    out = pack("%di" % len(ids := list(viterbi(unit, codec.v))), *ids)
                    if len(unit) > KEPT:
                        return out
                if len(self) >= CACHE:
                    self.old = dict(self)
                    self.clear()
                self[unit] = out
                return out

        self.cache = Cache()

    def split(self, text: str) -> list[str]:
        """The units of a text; a word mark that it has itself is the unit None."""
        parts = text.split(MARK)
        if len(parts) == 1:
            return self.units.findall(MARK + text.replace(" ", MARK)) if text else []
        out: list = []
        for n, part in enumerate(parts):
            if n:
                out.append(None)
            out.extend(self.units.findall((MARK if n == 0 else "") + part.replace(" ", MARK)))
        return out

    def _join(self, units: list[str]) -> np.ndarray:
        get = self.cache.__getitem__
        return np.frombuffer(b"".join([self.literal if u is None else get(u) for u in units] if None in units else map(get, units)), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self._join(self.split(text))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.out.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def codec_of(v: Vocabulary) -> Codec:
    """The codec of a vocabulary; a Python worker keeps it, and its cache, from task to task."""
    if not hasattr(v, "_codec"):
        v._codec = Codec(v)
    return v._codec


def _codec_rows(shared, schema: pa.Schema, ids_name: str, check: str | None):
    def run(batches):
        codec = codec_of(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            parts = [codec.encode(x or "") for x in texts]
            lens, valid = [len(x) for x in parts], [x is not None for x in texts]
            same = [x is None or codec.decode(y) == x for x, y in zip(texts, parts, strict=True)] if check else []
            offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
            values = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32())
            column = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([not x for x in valid], pa.bool_()) if not all(valid) else None)
            columns = [b.column(n) if n in b.schema.names and n not in (ids_name, check, "n_ids") else None for n in schema.names]
            made = {ids_name: column, "n_ids": pa.array(lens, pa.int64()), check: pa.array(same, pa.bool_()) if check else None}
            yield pa.RecordBatch.from_arrays([c if c is not None else made[n] for n, c in zip(schema.names, columns, strict=True)], schema=pa.schema([pa.field(n, (c if c is not None else made[n]).type) for n, c in zip(schema.names, columns, strict=True)]))

    return run


def encode(docs: DataFrame, path: str | None = None, ids: str = "ids", check: str | None = None) -> DataFrame:
    """The rows with `ids` (array<int>) and `n_ids`; check names a column that says whether decoding gives the text back."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(path or default_path()))
    fields = [f for f in docs.schema.fields if f.name not in (ids, "n_ids", check)]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), *([T.StructField(check, T.BooleanType())] if check else [])])
    names = pa.schema([pa.field(f.name, pa.null()) for f in schema.fields])
    return docs.mapInArrow(_codec_rows(shared, names, ids, check), schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of `ids`; null ids give a null text."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(path or default_path()))
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])
    names = [f.name for f in kept]

    def run(batches):
        codec = codec_of(shared.value)
        for b in batches:
            texts = [codec.decode(x.values.to_numpy()) if x.is_valid else None for x in b.column(ids)]
            arrays = [*(b.column(n) for n in names), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, text])

    return rows.mapInArrow(run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip").select("doc_id", "n_ids", "ids", "round_trip")
