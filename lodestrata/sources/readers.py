"""Sources: delimited files with strict headers, tables inside HTML, JSON answers, data addresses, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import html_text, squeeze


class UnexpectedFormat(ValueError):
    """A source that doesn't look as it should: an error, never an empty table."""


def _header(spark: SparkSession, path: str, sep: str, quote: str = '"') -> list[str]:
    line = spark.read.text(path).first()
    if line is None:
        raise UnexpectedFormat(f"{path} is empty")
    return [c.strip().strip(quote) for c in line[0].lstrip("﻿").rstrip("\r").split(sep)]


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """A quoted file with embedded line breaks. The header must be the one given, rows must have all columns.

    Columns in `drop` (personal data) leave the plan right after the scan, so they are never read out.
    One file is one task (quoted breaks can't be split): lay files out by year.
    """
    found = _header(spark, path, sep)
    if found != columns:
        raise UnexpectedFormat(f"header {found} is not {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, schema=schema, sep=sep, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=False, encoding="UTF-8")
    return rows.select(*[c for c in columns if c not in drop])


def html_rows(pages: DataFrame, key: str, html: str, columns: list[str]) -> DataFrame:
    """Rows of the table in each page as text columns; the first row must be the header given."""
    trs = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda c: squeeze(html_text(c)))
    rows = pages.select(key, F.posexplode(F.transform(trs, cells)).alias("row", "cells"))
    wrong = rows.where((F.col("row") == 0) & (F.col("cells") != F.array(*map(F.lit, columns))) | (F.size("cells") != len(columns)))
    bad = wrong.limit(1).collect()
    if bad:
        raise UnexpectedFormat(f"row {bad[0]['row']} of {bad[0][key]}: {bad[0]['cells']}")
    return rows.where("row > 0").select(key, "row", *[F.col("cells")[n].alias(c) for n, c in enumerate(columns)])


def list_items(pages: DataFrame, key: str, html: str, class_: str) -> DataFrame:
    """Numbered items "Name N (mark)" of a page's list: key, number, mark."""
    text = F.explode(F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<div\b[^>]*class=[\"']?{class_}[\"']?[^>]*>(.*?)</div\s*>"), F.lit(1)), lambda c: squeeze(html_text(c))))
    items = pages.select(key, text.alias("item"))
    return items.select(key, F.regexp_extract("item", r"(\d+)", 1).cast("int").alias("number"), F.nullif(F.regexp_extract("item", r"\(([^)]*)\)", 1), F.lit("")).alias("mark"), "item")


ANSWER = T.StructType(
    [
        *[T.StructField(n, T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("id", "ementa", "orgao", "relator", "data", "link", "original_bucket", "kind")] + [T.StructField("score", T.DoubleType())]))) for n in ("reranked_results", "results", "juris")],
    ]
)
_FIELDS = ("ementa", "orgao", "relator", "data", "link", "score")


def search_answers(pages: DataFrame, key: str, json_column: str) -> DataFrame:
    """Records of search answers: key, position, id and fields.

    The reranked list gives order and relevance, completed by the record of the same id in the plain
    lists; records that only these have follow. A page without any known list is an error.
    """
    read = pages.select(key, F.from_json(json_column, ANSWER).alias("a"))
    if read.where("a is null or (a.reranked_results is null and a.results is null and a.juris is null)").limit(1).count():
        raise UnexpectedFormat("an answer has no known list")
    part = lambda n, order: read.select(key, F.lit(order).alias("list"), F.posexplode(F.col(f"a.{n}")).alias("n", "r"))
    ranked = part("reranked_results", 0).where("r.original_bucket in ('results', 'juris') or (r.original_bucket is null and r.kind = 'juris')")
    plain = part("results", 1).unionByName(part("juris", 2)).where("r.id is not null")
    rows = ranked.unionByName(plain)
    base = F.max_by("r", F.when(F.col("list") > 0, F.struct("list", "n")))
    first = F.min_by("r", F.struct("list", "n"))
    one = rows.groupBy(key, F.col("r.id").alias("id")).agg(first.alias("f"), base.alias("b"), F.min(F.struct("list", "n")).alias("at"))
    position = F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1
    return one.select(key, position.alias("position"), "id", *[F.coalesce(F.col(f"f.{c}"), F.col(f"b.{c}")).alias(c) for c in _FIELDS])


def data_address(url: Column, most: int = 2 << 20, least: int = 20) -> Column:
    """struct(text, reason) of a data:text/html;base64 address: readable text, or why not."""
    head, body = F.regexp_extract(url, r"(?is)^(data:text/html[^,]*),", 1), F.regexp_replace(F.regexp_extract(url, r"(?s),(.*)$", 1), r"\s+", "")
    text = html_text(F.decode(F.unbase64(F.when(body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 == 0), body)), "UTF-8"))
    reason = F.when(head == "", "not_html").when(~head.rlike("(?i);base64"), "not_base64").when(F.length(body) * 3 / 4 > most, "too_large").when(~body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") | (F.length(body) % 4 != 0), "bad_base64").when(F.coalesce(F.length(text), F.lit(0)) < least, "no_text")
    return F.struct(F.when(reason.isNull(), text).alias("text"), reason.alias("reason"))


def file_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """year, url, mb of the yearly files of a list; the first line of a year counts."""
    year = F.regexp_extract(line, r"acordao-completo-(\d{4})\.csv", 1)
    size = F.regexp_replace(F.regexp_extract(line, r"(?i)(\d+(?:[.,]\d+)?)\s*(?:KB|MB|GB)\b", 1), ",", ".")
    unit = F.upper(F.regexp_extract(line, r"(?i)\d\s*(KB|MB|GB)\b", 1))
    mb = F.round(F.when(size != "", size.cast("double")) * F.when(unit == "GB", 1024.0).when(unit == "KB", 1 / 1024).otherwise(1.0), 2)
    rows = lines.withColumn("_n", F.monotonically_increasing_id()).where(year != "").select(year.cast("int").alias("year"), "_n", F.nullif(F.regexp_extract(line, r'https://[^\s"|;,]*acordao-completo-\d{4}\.csv', 0), F.lit("")).alias("url"), mb.alias("mb"))
    return rows.groupBy("year").agg(F.min_by(F.struct("url", "mb"), "_n").alias("r")).select("year", "r.url", "r.mb")


def receipt_for(wanted: DataFrame, receipts: DataFrame) -> DataFrame:
    """wanted: ask, id, link; receipts: receipt, id, link, sha256, size, content, at.

    A receipt whose content has its size and hash, by id, else by link if exactly one id carries that
    link; the newest wins, without a date last.
    """
    good = receipts.where((F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("size")))
    r = good.select("receipt", F.col("id").alias("r_id"), F.col("link").alias("r_link"), "at")
    by_id = wanted.join(r, F.col("id") == F.col("r_id")).select("ask", "receipt", "at", F.lit(0).alias("way"))
    alone = r.groupBy("r_link").agg(F.countDistinct("r_id").alias("n")).where("n = 1").select(F.col("r_link").alias("one_link"))
    by_link = wanted.join(r.join(alone, F.col("r_link") == F.col("one_link")), F.col("link") == F.col("r_link")).select("ask", "receipt", "at", F.lit(1).alias("way"))
    best = F.row_number().over(Window.partitionBy("ask").orderBy("way", F.col("at").desc_nulls_last(), "receipt"))
    return by_id.unionByName(by_link).withColumn("_n", best).where("_n = 1").select("ask", "receipt", "way")


def blocked(html: Column, title_only: bool = False) -> Column:
    """challenge, blocked or null: strong marks anywhere where pages are never content, weak ones in a short title only."""
    from ..functions.text import fold

    title = fold(squeeze(html_text(F.regexp_extract(F.element_at(F.split(html, r"(?i)<body[\s>]"), 1), r"(?is)<title[^>]*>(.*?)</title>", 1))))
    short = F.when(F.length(title) <= 80, title).otherwise(F.lit(""))
    where = short if title_only else F.concat_ws("\n", fold(html_text(html)), short)
    loader = F.lit(False) if title_only else fold(html).rlike(r"src=[\"'][^\"']*/tspd/")
    return F.when(where.rlike("pagina bloqueada|acesso bloqueado"), "blocked").when(where.rlike("verificacao de seguranca|digite o codigo da figura") | short.rlike("captcha|just a moment") | loader, "challenge")
