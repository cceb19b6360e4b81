"""HTML extraction by equivalence-class template deduction.

Pages of one host make a group; a host with more than GROUP pages is dealt over groups of about GROUP by
a hash of the page, so groups hang on the pages alone and not on the partitions. In a group every token,
an element under its path of tags and classes (digits aside) or a piece of text under its path, has an
occurrence vector: how often each page has it. Tokens with one vector make an equivalence class. A class
is valid if it stands on enough pages and its tokens come in one order, over and over, on each of them.
Valid classes nest by their paths into the template; a piece of text belongs to it only if its class
holds elements too. What is left under an element of the template is that element's slot.

Slots are judged for the whole group: the article is the template's <article> or <main> with most slot
text, or, without one, the smallest element that holds nearly all of it once menus (slots of links) and
elements named as aside are left out. A page's text is what stands in the slots of the article. Inside
them only elements that are no prose by their tag (menu, form, footer, aside) or are named outright as
adverts or reader comments go.

Defined cases: null and empty html give an empty text; cut tags at the end are dropped, cut character
references stay as they are; under three different pages no text can belong to a template, so elements
alone speak; repeated pages count once in vectors and are extracted alike; a page without any slot of the
article keeps all that isn't aside; a null url is the host ''; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tasks_for

#: Pages of a group, about, where a host has more.
GROUP = 128
#: Hosts with more pages than GROUP are broadcast up to this number of them, else joined.
MOST_HOT = 50_000
#: Groups with more html than this are parsed twice and not held parsed.
HELD_BYTES = 16 << 20
#: Share of a group's pages that a class must stand in, three pages at least.
SUPPORT = 0.25
#: Share of the text that an article without a tag must hold, and share of links that makes a menu.
MOST, LINKS = 0.8, 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|iframe|textarea|title|select)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^\s>/]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|$)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_MARK = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s>=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: No prose wherever they stand; a header is one outside an article only.
ASIDE_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
#: Names that speak outside an article's slots.
ASIDE_MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|sidebar|side|widget|menu|nav\w*|breadcrumbs?|pagination|pager|header|masthead|footer|copyright|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|toolbar|skip\w*|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
#: Whole names of boxes that are no prose inside an article either.
BOXES = frozenset("div section ul ol article".split())
BOX_NAMES = frozenset("ad ads advert advertisement sponsored comment comments comment-list commentlist disqus_thread share sharing newsletter popup cookie-notice".split())
#: A new one ends an open one of the same name.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
_CONTAINERS = frozenset("article section div ul ol table dl blockquote".split())

OUTER, INNER, ARTICLE, HEADING, HOLDS = 1, 2, 4, 8, 16


class Paths:
    """The element paths of a group's pages as numbers; 0 is the root."""

    def __init__(self):
        self.ids: dict[tuple[int, str], int] = {}
        self.parent, self.flags = [-1], [0]
        self.texts: dict[tuple[int, str], int] = {}

    def child(self, parent: int, name: str, marks: list[tuple[str, str]]) -> int:
        step = name + "".join(f".{re.sub('[0-9]+', '#', v)}" for _, v in marks)
        path = self.ids.get((parent, step))
        if path is None:
            path = self.ids[parent, step] = len(self.parent)
            self.parent.append(parent)
            said = " ".join(v for _, v in marks)
            names = {w.lower() for k, v in marks if k in ("class", "id") for w in v.split()}
            flags = 0
            if name in ("article", "main") or "main" in names or any(k == "role" and v.lower() == "main" for k, v in marks):
                flags |= ARTICLE
            if name in BOXES and names & BOX_NAMES:
                flags |= INNER | OUTER
                if names & {"comment", "comments", "comment-list", "commentlist", "disqus_thread"}:
                    flags = (flags | HOLDS) & ~ARTICLE
            if name in ASIDE_TAGS:
                flags |= INNER | OUTER | HOLDS
            elif name == "header" or (name not in ("html", "body") and not flags & ARTICLE and ASIDE_MARKS.search(said)):
                flags |= OUTER
            if name in HEADINGS:
                flags |= HEADING
            self.flags.append(flags)
        return path

    def text(self, path: int, text: str) -> int:
        return self.texts.setdefault((path, text), len(self.texts))

    def up(self, path: int):
        """The path and those around it, from the inside."""
        while path >= 0:
            yield path
            path = self.parent[path]


class Page:
    """The tokens of a page in order (paths as even, texts as odd numbers) and its blocks."""

    __slots__ = ("blocks", "tokens")

    def __init__(self, source: str, paths: Paths):
        self.tokens: list[int] = [0]
        #: (text, path of the block around it, its number as a text, words, words in links)
        self.blocks: list[tuple[str, int, int, int, int]] = []
        stack: list[tuple[str, int, int, bool]] = []  # name, path, path of the block around, hidden
        parts: list[str] = []
        links = anchors = 0
        around, hidden = 0, False

        def flush():
            nonlocal links
            if parts:
                words = "".join(parts).split()
                parts.clear()
                if words:
                    text = " ".join(words)
                    number = paths.text(around, text)
                    self.blocks.append((text, around, number, len(words), links))
                    self.tokens.append(2 * number + 1)
            links = 0

        def cut(at: int):
            nonlocal around, hidden, anchors
            anchors -= sum(s[0] == "a" for s in stack[at:])
            del stack[at:]
            around, hidden = stack[-1][2:] if stack else (0, False)

        for m in _TOKEN.finditer(source):
            t = m.group()
            if t[0] != "<" or t == "<":
                if hidden or (stack and stack[-1][0] == "head"):
                    continue
                t = t if "&" not in t else html.unescape(t)
                parts.append(t)
                if anchors:
                    links += len(t.split())
                continue
            if m.group(1) or t[1] in "!?":
                continue
            name = _NAME.match(t).group(1).lower()
            if t[-1] != ">":
                break
            if name in BLOCKS:
                flush()
            if t[1] == "/":
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if at is not None:
                    cut(at)
                continue
            if name in SELF_CLOSING:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] in _CONTAINERS), None)
                if at is not None and stack[at][0] == name:
                    cut(at)
            path = paths.child(stack[-1][1] if stack else 0, name, [(k.lower(), a or b or c) for k, a, b, c in _MARK.findall(t)] if "=" in t else [])
            self.tokens.append(2 * path)
            if name in VOID or t.endswith("/>"):
                continue
            around = path if name in BLOCKS else around
            hidden = hidden or bool(_HIDDEN.search(t))
            anchors += name == "a"
            stack.append((name, path, around, hidden))
        flush()


class Template:
    """Nested valid classes: the elements, the template's own texts, and the slots that make the article."""

    def __init__(self, paths: Paths):
        self.paths = paths
        #: path of an element -> its class; class -> the class it is nested in
        self.elements: dict[int, int] = {}
        self.nested: dict[int, int] = {}
        self.texts: set[int] = set()
        #: elements whose slots are the article's
        self.article: set[int] = set()

    def slot(self, path: int) -> tuple[int, bool]:
        """The element in whose slot a path stands (-1: none), and whether what lies between is no prose."""
        aside = False
        for p in self.paths.up(path):
            if p in self.elements:
                return p, aside
            aside = aside or bool(self.paths.flags[p] & INNER)
        return -1, aside


def _classes(pages: list[Page]) -> dict[int, tuple[int, int]]:
    """(pages, vector) of every token; a vector is the sum of a hash of (page, count) over its pages."""
    seen: dict[int, list[int]] = {}
    for n, page in enumerate(pages):
        counts: dict[int, int] = {}
        for t in page.tokens:
            counts[t] = counts.get(t, 0) + 1
        for t, c in counts.items():
            own = seen.setdefault(t, [0, 0])
            own[0] += 1
            own[1] ^= hash((n, c, 0x9E3779B9)) & 0xFFFFFFFFFFFFFFFF
    return {t: (n, v) for t, (n, v) in seen.items()}


def _in_order(pages: list[Page], vector: dict[int, tuple[int, int]], size: dict[tuple[int, int], int]) -> set[tuple[int, int]]:
    """The classes whose tokens come in one order, over and over, on all pages."""
    order: dict[tuple[int, int], list[int]] = {}
    bad = set()
    for page in pages:
        at: dict[tuple[int, int], int] = {}
        for t in page.tokens:
            c = vector.get(t)
            if c is None or c in bad:
                continue
            known, i = order.setdefault(c, []), at.get(c, 0)
            if len(known) < size[c] and i == len(known) and t not in known:
                known.append(t)
            elif known[i % size[c] if len(known) == size[c] else i - 1] != t or len(known) < size[c]:
                bad.add(c)
            at[c] = i + 1
    return set(size) - bad


def deduce(pages: list[Page], paths: Paths) -> Template:
    """The template of same-host pages."""
    out = Template(paths)
    if not pages:
        return out
    least = max(min(3, len(pages)), SUPPORT * len(pages))
    vector = {t: c for t, c in _classes(pages).items() if c[0] >= least}
    size: dict[tuple[int, int], int] = {}
    for c in vector.values():
        size[c] = size.get(c, 0) + 1
    valid = _in_order(pages, vector, size)
    number = {c: n for n, c in enumerate(sorted(valid))}
    out.elements = {t // 2: number[c] for t, c in vector.items() if t % 2 == 0 and c in number}
    held = set(out.elements.values())
    if len(pages) >= 3:
        out.texts = {t // 2 for t, c in vector.items() if t % 2 and number.get(c) in held}
    for p, c in out.elements.items():
        around = next((q for q in paths.up(paths.parent[p]) if out.elements.get(q, c) != c), None)
        if around is not None:
            out.nested[c] = out.elements[around]
    out.article = _article(pages, out)
    return out


def _article(pages: list[Page], t: Template) -> set[int]:
    """The elements whose slots are the article's, from the text in all slots of the group."""
    flags, up = t.paths.flags, t.paths.up
    words: dict[int, int] = {}
    links: dict[int, int] = {}
    heads: dict[int, int] = {}
    for page in pages:
        for _, path, number, n, linked in page.blocks:
            if number in t.texts:
                continue
            head = bool(flags[path] & HEADING)
            for p in up(path):
                if p in t.elements:
                    words[p] = words.get(p, 0) + n
                    links[p] = links.get(p, 0) + linked
                    heads[p] = heads.get(p, 0) + head
    outside = lambda p, bits: any(flags[q] & bits for q in up(t.paths.parent[p]))
    tagged = [p for p in t.elements if flags[p] & ARTICLE and words.get(p) and not outside(p, HOLDS)]
    # an article inside <main> stands for it where it holds the larger half
    roots = {p for p in tagged if not any(p in list(up(q))[1:] and 2 * words[q] >= words[p] for q in tagged)}
    roots = {p for p in roots if not any(q in roots for q in list(up(p))[1:])}
    if roots:
        top = max(words[p] for p in roots)
        roots = {p for p in roots if 10 * words[p] >= top}
        out_of = lambda p: bool(flags[p] & INNER)
    else:
        dull = {p for p in t.elements if flags[p] & OUTER or links.get(p, 0) > LINKS * words.get(p, 1)}
        out_of = dull.__contains__
        clear = lambda p: not any(q in dull for q in up(p))
        lost = {p: sum(words.get(q, 0) for q in dull if p in list(up(q))[1:] and clear(t.paths.parent[q])) for p in t.elements}
        open_ = {p: words[p] - lost[p] for p in t.elements if words.get(p) and clear(p)}
        whole, titles = max(open_.values(), default=0), max((heads.get(p, 0) for p in open_), default=0)
        fit = [p for p, n in open_.items() if n >= MOST * whole and heads.get(p, 0) == titles and not flags[p] & HEADING]
        roots = {max(fit, key=lambda p: len(list(up(p))))} if fit else set()
    keep = set()
    for p in t.elements:
        for q in up(p):
            if out_of(q) and q not in roots:
                break
            if q in roots:
                keep.add(p)
                break
    return keep


def main_text(page: Page, template: Template) -> str:
    """What stands in the article's slots, a block a line; without a template all that the page shows."""
    if not template.elements:
        return "\n".join(b[0] for b in page.blocks)
    own = [b for b in page.blocks if b[2] not in template.texts]
    slots = {path: template.slot(path) for _, path, _, _, _ in own}
    kept = [b[0] for b in own if slots[b[1]][0] in template.article and not slots[b[1]][1]]
    if not kept:
        flags, up = template.paths.flags, template.paths.up
        kept = [b[0] for b in own if not any(flags[p] & OUTER for p in up(b[1]))]
    return "\n".join(kept)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_classes", pa.int64()), ("n_slots", pa.int64())])
_OUT_SQL = "page_id long, url string, text string, n_chars long, n_classes long, n_slots long"


def extract_group(sources: list[str]) -> tuple[list[str], Template]:
    """The main texts of the pages of a group, and its template."""
    paths = Paths()
    held = sum(map(len, sources)) <= HELD_BYTES
    first: dict[str, int] = {}
    for s in sources:
        first.setdefault(s, len(first))
    if held:
        pages = [Page(s, paths) for s in first]
        template = deduce(pages, paths)
    else:

        class Again(list):  # parsed anew at each walk
            def __iter__(self):
                return (Page(s, paths) for s in first)

            def __len__(self):
                return len(first)

            def __bool__(self):
                return bool(first)

        pages = Again()
        template = deduce(pages, paths)
    texts = [main_text(p, template) for p in pages]
    return [texts[first[s]] for s in sources], template


def _extract_rows(batches):
    run, key = [], None

    def done():
        texts, template = extract_group([x[2] for x in run])
        n_classes, n_slots = len(set(template.elements.values())), len(template.article)
        columns = [[x[0] for x in run], [x[1] for x in run], texts, [len(t) for t in texts], [n_classes] * len(run), [n_slots] * len(run)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    for b in batches:
        columns = [b.column(c) for c in ("page_id", "url", "host", "part", "html")]
        for i in range(b.num_rows):
            page_id, url, host, part, source = (c[i].as_py() for c in columns)
            if run and (host, part) != key:
                yield done()
                run = []
            key = (host, part)
            run.append((page_id, url, source or ""))
    if run:
        yield done()


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars, and how many classes and article slots its group's template has."""
    n = tasks_for(pages)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    hot = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select(F.col("host").alias("_h"), F.ceil(F.col("n") / GROUP).cast("int").alias("_parts"))
    bounded = hot.limit(MOST_HOT + 1).count() <= MOST_HOT
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("_parts"))).cast("int")
    dealt = keyed.join(F.broadcast(hot) if bounded else hot, F.col("host") == F.col("_h"), "left").withColumn("part", part).drop("_h", "_parts")
    ordered = dealt.repartition(n, "host", "part").sortWithinPartitions("host", "part", "page_id")
    return ordered.mapInArrow(_extract_rows, _OUT_SQL)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
