"""Corpus search: by scan, or by a positional inverted index with the same answer."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, expression, fold, fold_plain, normalise, normalise_plain, once

def read_query(query: str) -> list[str]:
    """Words and "phrases" of a query."""
    return [t.strip() for a, b in re.findall(r'"([^"]+)"|(\S+)', query) if (t := a or b).strip()]


def term_words(term: str) -> tuple[list[str], list[int], bool]:
    """The words of a normalised term, their distances from the first, and whether the index alone decides."""
    found = list(re.finditer(r"[^\W_]+", term))
    gaps = [term[(found[i - 1].end() if i else 0) : m.start()] for i, m in enumerate(found)] + [term[found[-1].end() :] if found else ""]
    at, out = 0, []
    for i, g in enumerate(gaps[:-1]):
        at += 0 if i == 0 else (1 if g == " " else 2)
        out.append(at)
    return [m.group() for m in found], out, bool(found) and not gaps[0] and not gaps[-1] and all(g == " " for g in gaps[1:-1])


def build_index(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The index: term, key, positions (array, ascending). One space moves a position by 1, any other gap by 2.

    A text is cut at its wide gaps; a word's position is its number plus how many cuts stand before it.
    """
    core = F.regexp_replace(normalise(F.col(text)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    parts = F.split(core, r"(?! [\p{L}\p{N}])[^\p{L}\p{N}]+")
    words = F.flatten(F.transform(parts, lambda part, i: F.transform(F.split(part, " "), lambda w: F.struct(w.alias("term"), i.alias("cut")))))
    placed = F.array_sort(F.transform(words, lambda w, n: F.struct(w["term"].alias("term"), (n + w["cut"]).alias("position"))))

    # a document's places are grouped inside its row: where a term begins in the sorted places, and where the next one does
    def grouped(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (w[i]["term"] != w[F.greatest(i - 1, F.lit(0))]["term"]))
        entry = lambda i, j: F.struct(w[i]["term"].alias("term"), F.transform(F.slice(w, i + 1, j - i), lambda x: x["position"]).alias("positions"))
        return bound(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(w))), entry))

    rows = docs.where(F.col(text).isNotNull()).select(key, *keep, F.explode(bound(placed, grouped)).alias("_e"))
    return rows.select("_e.term", key, *keep, "_e.positions").where("term <> ''")


def vocabulary(index: DataFrame) -> DataFrame:
    """term, df (documents), n (places)."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).cast("long").alias("n"))


def write_index(index: DataFrame, key: str, path: str, partition: str | None = None) -> None:
    """As Parquet, in ranges of (term, key), so a frequent term is dealt over files and a search skips row groups."""
    out = index.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite")
    (out.partitionBy(partition) if partition else out).parquet(path)


def stored_index(docs: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """The index of a table's files, built once: its name says which files, of what size and date, so a changed table has another."""
    spark = docs.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    states = [fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path) for fs_path in map(spark._jvm.org.apache.hadoop.fs.Path, sorted(docs.inputFiles()))]
    said = "|".join(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in states) + f"|{key}|{text}"
    path = f"{folder}/index_{hashlib.sha256(said.encode()).hexdigest()[:24]}"
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        write_index(build_index(docs.select(key, text), key, text), key, path)
    return spark.read.parquet(path)


def search_index(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys of the documents that have every term (word or phrase). Only the terms' postings are read; one shuffle by key."""
    plan = [term_words(normalise_plain(t)) for t in terms]
    needed = sorted({w for words, _, _ in plan for w in words})
    if not needed:
        return index.select(key).limit(0)
    postings = index.where(F.col("term").isin(needed)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("p"))
    conditions = []
    for words, distances, _ in plan:
        have = reduce(lambda a, b: a & b, (F.map_contains_key("p", w) for w in words))
        if len(words) > 1:
            def fits(start: Column, words=words, distances=distances) -> Column:
                return reduce(lambda a, b: a & b, (F.array_contains(F.col("p")[w], start + d) for w, d in zip(words[1:], distances[1:], strict=True)))

            have = have & F.exists(F.col("p")[words[0]], lambda s: fits(s))  # noqa: B023
        conditions.append(have)
    return postings.where(reduce(lambda a, b: a & b, conditions)).select(key)


def search_scan(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows whose text has every term; plain conditions first, then the patterns."""

    def holds(normal: Column) -> Column:
        return reduce(lambda a, b: a & b, (normal.contains(normalise_plain(t)) & normal.rlike(expression(t)) for t in terms))

    return docs.where(once(normalise(F.col(text)), holds)) if terms else docs


def context(text: Column, term: str, around: int = 100) -> Column:
    """What stands around the first place of a term; null without one."""
    plain = F.regexp_replace(text, r"\s+", " ")
    at = F.instr(fold(plain), fold_plain(term))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(F.length(plain) + 1, at + len(term) + around)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substring(plain, start, end - start)), F.when(end <= F.length(plain), "…").otherwise(""))
    return F.when(at > 0, cut)


def newest(rows: DataFrame, date: str, number: str, order: str, most: int) -> DataFrame:
    """The `most` newest rows; ties by number, then as they came."""
    return rows.orderBy(F.col(date).desc(), F.col(number).desc(), F.col(order).asc()).limit(most)
