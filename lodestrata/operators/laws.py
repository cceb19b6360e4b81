"""Texts of laws: paragraphs of a page, and which device each line belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bound, html_text
from .references import to_roman

# How lines of a law begin and end.
RANGE = r"^Arts\.\s*(?:(\d+)[º°]?\s+a\s+(\d+)[º°]?\.?(?=\s|$)|\S+)"
ARTICLE = r"^Art\.\s*(?:(\d+(?:\.\d{3})*)[º°]?((?:-[A-Z])*)\.?(?=\s|$)|\S+)"
PARAGRAPH = r"^§\s*(?:(\d+)[º°]?((?:-[A-Z])*)\.?(?=\s|$)|\S+)"
ONLY_PARAGRAPH = r"^Par[áa]grafo\s+[úu]nico\.?(?=\s|$)"
ITEM = r"^([IVXLCDM]+)\s*[-–—]"
LETTER = r"^([a-z])\)"
HEADING = r"^(?:PARTE|LIVRO|T[ÍI]TULO|CAP[ÍI]TULO|SE[ÇC][ÃA]O|Se[çc][ãa]o|SUBSE[ÇC][ÃA]O|Subse[çc][ãa]o)\s+(?:[IVXLCDM]+(?:-[A-Z])?|[ÚU]NIC[OA]|[ÚU]nic[oa]|GERAL|Geral|ESPECIAL|Especial)$"
CLOSE = r"^(?:Rio de Janeiro|Brasília),\s.*\d{4}\s*[;,].*Independência"
PENALTY = r"^Pena\s*[-–—:]"
NOTE = r"(?s)^\(.*\)$"
LONGEST_TITLE = 200
MOST_ITEMS = 400


def law_paragraphs(html: Column, start: Column) -> Column:
    """The paragraphs after the line `start` and before the closing; null where the start isn't there once or nothing closes."""

    def between(p: Column) -> Column:
        at = F.array_position(p, start).cast("int")
        rest = F.slice(p, at + 1, F.size(p))
        closes = F.transform(rest, lambda x: x.rlike(CLOSE))
        end = F.array_position(closes, F.lit(True)).cast("int")
        once = F.size(F.filter(p, lambda x: x == start)) == 1
        return F.when(once, F.when(end > 0, F.slice(rest, F.lit(1), end - 1)))

    return bound(F.filter(F.transform(F.split(html_text(html), "\n"), F.trim), lambda x: x != ""), between)


def _label(p: Column) -> Column:
    """struct(kind, segment, label) of a line; nulls for one without a label, segment `?` where its number can't be read."""
    get = lambda pattern, n: F.regexp_extract(p, pattern, n)
    number = lambda pattern, name: F.when(get(pattern, 1) == "", "?").otherwise(F.concat(F.lit(name), F.regexp_replace(get(pattern, 1), r"\.", ""), get(pattern, 2)))
    roman = F.array_position(F.array(*[F.lit(to_roman(n)) for n in range(1, MOST_ITEMS + 1)]), get(ITEM, 1))
    item = F.when(roman > 0, F.concat(F.lit("inc"), roman.cast("string"))).otherwise("?")
    spread = F.when(get(RANGE, 1) == "", "?").otherwise(F.concat(F.lit("art"), get(RANGE, 1), F.lit("-"), get(RANGE, 2)))
    made = lambda kind, segment, pattern: F.struct(F.lit(kind).alias("kind"), segment.alias("segment"), F.trim(get(pattern, 0)).alias("label"))
    return (
        F.when(p.rlike(RANGE), made("range", spread, RANGE))
        .when(p.rlike(ARTICLE), made("article", number(ARTICLE, "art"), ARTICLE))
        .when(p.rlike(PARAGRAPH), made("paragraph", number(PARAGRAPH, "par"), PARAGRAPH))
        .when(p.rlike(ONLY_PARAGRAPH), made("paragraph", F.lit("par1u"), ONLY_PARAGRAPH))
        .when(p.rlike(ITEM), made("item", item, ITEM))
        .when(p.rlike(LETTER), made("letter", F.concat(F.lit("ali"), (F.ascii(get(LETTER, 1)) - 96).cast("string")), LETTER))
    )


def _like_title(p: Column) -> Column:
    """Whether a line may be a title: a capital first, no point last, short; notes at its end don't count."""
    bare = F.regexp_replace(p, r"(?:(?<=\S)\s*\([^()]*(?:\([^()]*\)[^()]*)*\))+$", "")
    return bound(bare, lambda b: b.rlike(r"^\p{Lu}") & ~b.rlike(r"[.;:,?!]$") & (F.length(b) <= LONGEST_TITLE))


def law_lines(laws: DataFrame, key: str, paragraphs: str) -> DataFrame:
    """key, n, device, label, text: the lines of each law with the device that owns them, as art1_cpt_inc2_ali3.

    A label opens a device under the last ones above it; a line without one belongs to the open device, a penalty to
    the caput or paragraph. Headings end the article. Left out are lines before the first article, headings, loose
    titles (a line like a title before a label, a heading, the end or another of them) and the notes in brackets
    right after these. What stands between quotes that a line opens is text, whatever it looks like, up to the next
    article or heading at most; the two kinds of marks are not told apart. Levels are windows in the order of a law's lines:
    a device is open if its label came after the last label above it, so no state is carried line by line.
    """
    p, kind, heading, note = F.col("_p"), F.col("_l.kind"), F.col("_heading"), F.col("_note")
    # the patterns meet each line once, inside the row, before any window
    read = F.transform(paragraphs, lambda x: F.struct(x.alias("_p"), _label(x).alias("_l"), x.rlike(HEADING).alias("_heading"), x.rlike(NOTE).alias("_note"), x.rlike(PENALTY).alias("_penalty"), _like_title(x).alias("_may")))
    rows = laws.select(key, F.posexplode(read).alias("n", "_x")).select(key, "n", "_x.*")
    whole = Window.partitionBy(key).orderBy("n")
    before, upto, after = (whole.rowsBetween(*w) for w in ((Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0), (1, Window.unboundedFollowing)))

    # quotes: a line that opens and doesn't close sets, one that closes more ends, an article or heading ends
    times = lambda mark: F.length("_p") - F.length(F.replace(p, F.lit(mark), F.lit("")))
    ends = heading | F.coalesce(kind.isin("article", "range"), F.lit(False))
    curly = times("“") - times("”")
    straight = times('"') % 2 == 1
    opens = kind.isNull() & ((p.startswith("“") & (curly > 0)) | (p.startswith('"') & straight))
    closes = ends | (curly < 0) | (straight & ~p.startswith('"'))
    # a straight mark that begins a line opens or closes, by turns since the last line that surely closes
    marked = rows.withColumns({"_ends": ends, "_opens": opens, "_sure": F.last(F.when(closes, F.col("n")), True).over(before)})
    turn = Window.partitionBy(key, "_sure").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    by_turns = F.sum(F.when(F.col("_opens") & p.startswith('"'), 1).otherwise(0)).over(turn) % 2 == 1
    set_ = F.max(F.col("_opens") & p.startswith("“")).over(turn)
    quoted = marked.withColumn("_quoted", ~F.col("_ends") & (F.coalesce(by_turns, F.lit(False)) | F.coalesce(set_, F.lit(False))))

    like = kind.isNull() & ~heading & ~F.col("_penalty") & F.col("_may")
    follows = F.first(F.when(~F.col("_like") & ~note, kind.isNotNull() | heading), ignorenulls=True).over(after)
    titled = quoted.withColumn("_like", like).withColumn("_title", F.col("_like") & ~F.col("_quoted") & F.coalesce(follows, F.lit(True)))
    after_title = note & F.coalesce(F.last(F.when(~note, F.col("_title")), True).over(before), F.lit(False))
    left_out = ~F.col("_quoted") & (heading | F.col("_title") | after_title)

    # levels: the last label of each kind, open while no later label above it came
    counts = ~F.col("_quoted")
    base = F.last(F.when(heading & counts, F.struct("n", F.lit(None).cast("string").alias("segment"), F.lit("heading").alias("kind"))).when(counts & kind.isin("article", "range"), F.struct("n", F.col("_l.segment").alias("segment"), kind.alias("kind"))), True).over(upto)
    last = lambda *kinds: F.last(F.when(counts & kind.isin(*kinds), F.struct("n", F.col("_l.segment").alias("segment"))), True).over(upto)
    levels = titled.withColumns({"_out": left_out, "_b": base, "_2": last("paragraph"), "_3": last("item"), "_4": last("letter")})
    open_2 = F.col("_2.n") > F.col("_b.n")
    over_3 = F.greatest("_b.n", F.when(open_2, F.col("_2.n")))
    open_3 = F.col("_3.n") > over_3
    open_4 = (F.col("_4.n") > over_3) & (~F.coalesce(open_3, F.lit(False)) | (F.col("_4.n") > F.col("_3.n")))
    penalty = kind.isNull() & F.col("_penalty") & counts
    parts = F.when(
        F.col("_b.kind") == "article",
        F.concat_ws("_", F.col("_b.segment"), F.when(open_2, F.col("_2.segment")).otherwise("cpt"), F.when(open_3 & ~penalty, F.col("_3.segment")), F.when(open_4 & ~penalty, F.col("_4.segment"))),
    ).when(F.col("_b.kind") == "range", F.col("_b.segment"))
    label = F.when(counts & ((F.col("_b.kind") == "article") | (kind == "range")), F.col("_l.label"))
    text = F.when(label.isNotNull(), F.ltrim(F.substring(p, F.length(label) + 1, F.length(p)))).otherwise(p)
    return levels.where(~F.col("_out")).select(key, "n", parts.alias("device"), label.alias("label"), text.alias("text")).where("device is not null")
