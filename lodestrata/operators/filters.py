"""Conditions on texts and metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import expression, fold, fold_plain, normalise, normalise_plain, once


def read_terms(value, groups: bool):
    """A filter argument: a JSON list or one text; never split at commas. Errors say what is accepted."""
    import json

    if value is None:
        return []
    if isinstance(value, str):
        try:
            read = json.loads(value)
        except ValueError:
            read = None
        value = read if isinstance(read, list) else ([[value]] if groups else [value])
    rows = value if groups else [value]
    good = isinstance(value, list) and all(isinstance(g, list) and g and all(isinstance(t, str) and t.strip() for t in g) for g in (rows if groups else rows if value else []))
    if not good:
        raise ValueError("a list of groups of terms is expected" if groups else "a list of terms is expected")
    return value


def passes(text: Column, must: list[list[str]] = (), must_not: list[str] = ()) -> Column | None:
    """Every group has a whole expression in the text and no excluded one is there; None without conditions.

    Plain `contains` conditions that the patterns imply stand first, so most rows never meet a pattern.
    """
    if not must and not must_not:
        return None

    def holds(normal: Column) -> Column:
        has = lambda t: normal.contains(normalise_plain(t)) & normal.rlike(expression(t))
        parts = [reduce(lambda a, b: a | b, map(has, group)) for group in must] + [~has(t) for t in must_not]
        return reduce(lambda a, b: a & b, parts)

    return once(normalise(text), holds)


def split_by_filter(items: DataFrame, text: str, must=(), must_not=()) -> DataFrame:
    """Adds `filter_status`: passed, excluded or no_text; without conditions all pass."""
    ok = passes(F.col(text), must, must_not)
    empty = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    return items.withColumn("filter_status", F.lit("passed") if ok is None else F.when(empty, "no_text").when(ok, "passed").otherwise("excluded"))


def metadata(kind: str | None = None, body: str | None = None, rapporteur: str | None = None, columns=("kind", "body", "rapporteur")) -> Column:
    """Kind equal, body and rapporteur contained; case and accents don't count."""
    out = F.lit(True)
    if kind:
        out = out & (fold(F.col(columns[0])) == fold_plain(kind))
    for value, name in ((body, columns[1]), (rapporteur, columns[2])):
        if value:
            out = out & fold(F.col(name)).contains(fold_plain(value))
    return out


def missing(pairs: list[tuple[str, Column]]) -> Column:
    """Names, in the order given, of the fields whose column is null or empty."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(n)) for n, c in pairs]))


def on_host(url: Column, domain: str) -> Column:
    """An https address on the domain or under it."""
    host = F.lower(F.regexp_extract(url, r"^https://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return (host == domain) | host.endswith("." + domain)


def notice_as_content(text: Column, start: str, most: int = 600) -> Column:
    """A short text that begins with a notice is no content: empty."""
    return F.when((F.length(text) < most) & F.lower(text).startswith(start.lower()), F.lit("")).otherwise(text)
