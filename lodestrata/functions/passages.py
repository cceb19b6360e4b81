"""Passages of texts and small readings of pages, numbers and dates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, fold, html_text, squeeze, stems


def _folded(text: str) -> tuple[str, list[int]]:
    """Folded text, and the place in the text of each of its characters (and of its end)."""
    out, at = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFD", c.lower()):
            if not 0x300 <= ord(d) <= 0x36F:
                out.append(d)
                at.append(i)
    return "".join(out), [*at, len(text)]


def _cut(text: str, start: int, end: int) -> str:
    """A slice that leaves out words cut in two (up to 20 characters), with dots where it was cut."""
    split = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    if split(start):
        m = re.match(r"[^\W_]*", text[start:])
        start += m.end() if m.end() <= 20 else 0
    if split(end):
        m = re.search(r"[^\W_]*$", text[start:end])
        end -= len(m.group()) if len(m.group()) <= 20 else 0
    return ("…" if start > 0 else "") + text[start:end].strip() + ("…" if end < len(text) else "")


def passage_of(text: str, formulations: list[str], size: int) -> str:
    """About `size` characters where most different words of the best formulation stand together; else the start."""
    text = re.sub(r"\s+", " ", text or "").strip()
    folded, at = _folded(text)
    best, chosen = 0.0, []
    for f in formulations:
        known = stems(f)
        share = sum(bool(re.search(s.java, folded)) for s in known) / len(known) if known else 0.0
        if share > best:
            best, chosen = share, known
    hits = []
    for n, s in enumerate(chosen):
        for m in re.finditer(s.java, folded):
            a = m.start() + (0 if re.match("[a-z0-9]", m.group()) else 1)
            b = re.compile("[a-z0-9]*").match(folded, a).end()
            hits.append((at[a], at[b], n))
    if not hits:
        return _cut(text, 0, min(size, len(text)))
    hits.sort()
    top = (0, 0, 0)  # different words, start, end
    for i, (a, _, _) in enumerate(hits):
        inside = [h for h in hits[i:] if h[1] <= a + size]
        n = len({h[2] for h in inside})
        if n > top[0]:
            top = (n, a, max(h[1] for h in inside))
    spare = max(0, size - (top[2] - top[1]))
    start = max(0, min(top[1] - spare // 2, len(text) - size))
    return _cut(text, start, min(len(text), max(top[2], start + size)))


def passage(text: Column, formulations: list[str], size: int = 300) -> Column:
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: passage_of(t, formulations, size) if t is not None else None)

    return run(text)


def unrepeated(text: str) -> tuple[str, int]:
    """The last copy of a text that is one block over and over (a footer in parentheses may follow), and how often.

    The smallest period is found with the border table of the words, in one pass.
    """
    words = list(re.finditer(r"\S+", text or ""))
    w = [m.group() for m in words]
    end = len(w)
    tails = [end] + [i for i in range(1, end) if w[i].startswith("(")]
    for cut in sorted(set(tails), reverse=True):
        if cut < end and not w[-1].endswith(")"):
            break
        part, border = w[:cut], [0] * cut
        for i in range(1, cut):
            k = border[i - 1]
            while k and part[i] != part[k]:
                k = border[k - 1]
            border[i] = k + (part[i] == part[k])
        period = cut - border[-1] if cut else 0
        if period and cut % period == 0 and cut // period >= 2:
            times = cut // period
            return text[words[(times - 1) * period].start() :].rstrip(), times
    return text, 1


def html_hints(html: Column) -> Column:
    """struct(cut, hidden): the page ends inside a tag or without one; something is marked as hidden."""
    end = F.regexp_replace(html, r"\s+$", "")
    hidden = html.rlike(r"(?is)<[a-z][^<>]*\s(?:hidden(?=[\s=>/])|aria-hidden\s*=\s*[\"']?true\b|style\s*=\s*(?:\"[^\"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden))")
    return F.struct(((end != "") & ~end.endswith(">")).alias("cut"), hidden.alias("hidden"))


def overlap(summary: Column, text: Column, block: int = 40) -> Column:
    """Share of a summary's blocks of letters and digits that a text contains; 0 without a whole block."""
    bare = lambda c: F.regexp_replace(fold(c), "[^a-z0-9]", "")
    body = bare(F.regexp_replace(summary, r"(?i)\([^()]*julgado em[^()]*\)\s*$", ""))

    def share(_, both):  # body is bound here, so it is made once a row and not once a block
        n = F.floor(F.length(both["b"]) / block).cast("int")
        blocks = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), lambda i: F.substring(both["b"], i * block + 1, F.lit(block)))
        return F.coalesce(F.try_divide(F.size(F.filter(blocks, lambda b: both["t"].contains(b))), n), F.lit(0.0))

    return F.aggregate(F.array(F.struct(body.alias("b"), bare(text).alias("t"))), F.lit(0.0), share)


def search_word(summary: Column, default: str = "acórdão") -> Column:
    """The first word of five letters or more that isn't the label."""
    found = F.filter(F.regexp_extract_all(summary, F.lit(r"(\p{L}{5,})")), lambda w: F.lower(w) != "ementa")
    return F.coalesce(F.when(F.size(found) > 0, F.element_at(found, 1)), F.lit(default))


def on_word(text: Column, most: int) -> Column:
    """A text of `most` characters at most, cut between words."""
    plain = squeeze(text)
    whole = F.regexp_extract(F.substring(plain, 1, most + 1), r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(plain) <= most, plain).when(whole != "", F.rtrim(whole)).otherwise(F.substring(plain, 1, most))


def header_number(text: Column, titles: str, most: int = 2000) -> Column:
    """The one process number that stands before the first title; null without one or with two."""
    region = F.substring(F.element_at(F.split(text, titles, 2), 1), 1, most)
    found = F.regexp_extract_all(region, F.lit(r"(\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4})"))
    return F.when(F.size(F.array_distinct(F.transform(found, digits))) == 1, F.element_at(found, 1))


def loose_instant(text: Column) -> Column:
    """ISO 8601 or yyyyMMddHHmmss as a timestamp (UTC where no zone is said); null otherwise."""
    t = F.trim(text)
    compact = F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))
    return F.when(t.rlike(r"^\d{14}$"), compact).when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))


def next_midnight(at: Column, hours_west: int = 3) -> Column:
    """The next civil midnight west of Greenwich."""
    shift = F.expr(f"interval {hours_west} hours")
    return F.date_trunc("day", at - shift) + F.expr("interval 1 day") + shift


# States in the order of their numbers in process numbers.
STATES = ("ac", "al", "ap", "am", "ba", "ce", "df", "es", "go", "ma", "mt", "ms", "mg", "pa", "pb", "pr", "pe", "pi", "rj", "rn", "rs", "ro", "rr", "sc", "se", "sp", "to")


def court_of(segment: Column) -> Column:
    """The court of a segment J.TR: state, labour, federal and highest courts."""
    j, tr = F.element_at(F.split(segment, r"\."), 1), F.element_at(F.split(segment, r"\."), 2).cast("int")
    states = F.array(*[F.lit("tjdft" if s == "df" else f"tj{s}") for s in STATES])
    return F.when(j == "1", "stf").when(j == "3", "stj").when((j == "8") & tr.between(1, len(STATES)), F.try_element_at(states, tr)).when((j == "5") & tr.between(1, 24), F.concat(F.lit("trt"), tr.cast("string"))).when((j == "4") & tr.between(1, 6), F.concat(F.lit("trf"), tr.cast("string")))


def process_page(number: Column, address: str, segment: str = "809") -> Column:
    """The address of a process of one segment, from its 20 digits; null for others."""
    d = digits(number)
    p = lambda a, n: F.substring(d, a, n)
    shown = F.concat(F.lit(address), p(1, 7), F.lit("-"), p(8, 2), F.lit("."), p(10, 4), F.lit("."), p(14, 1), F.lit("."), p(15, 2), F.lit("."), p(17, 4))
    return F.when((F.length(d) == 20) & (F.substring(d, 14, 3) == segment), shown)


def decoded(content: Column, content_type: Column) -> Column:
    """Bytes as text in the character set that is declared (header, meta, XML); UTF-8 without or with an unknown one (windows-1252 is read as ISO-8859-1, the nearest that Spark knows)."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    said = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    name = F.lower(F.coalesce(said(content_type, r"(?i)charset\s*=\s*[\"']?([\w.:-]+)"), said(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)"), said(head, r"(?i)^<\?xml[^>]+encoding\s*=\s*[\"']([\w.:-]+)"), F.lit("utf-8")))
    latin = name.isin("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii", "ascii")
    return F.when(latin, F.decode(content, "ISO-8859-1")).when(name.isin("utf-16", "utf-16le", "utf-16be"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))


def page_title(html: Column) -> Column:
    return squeeze(html_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
