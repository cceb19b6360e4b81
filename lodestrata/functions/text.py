"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and what they are without (computed, not listed).
_MARKED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1 and c == c.lower()]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]
#: White space as the retrieval rules mean it, no-break and wide spaces included.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Words of three letters or more that do not count in a formulation, without accents.
STOP_WORDS = frozenset(
    (
        "para com art arts lei leis que dos das nos nas aos pelo pela pelos pelas por uma umas uns sob sobre "
        "entre como seu sua seus suas ele ela eles elas este esta esse essa isso aquele aquela tal"
    ).split(" ")
)
STEM = 6


def fold(text: Column) -> Column:
    """Lower case without accents (Latin letters)."""
    return F.translate(F.regexp_replace(F.lower(text), r"[\u0300-\u036f]", ""), "".join(_MARKED), "".join(_PLAIN))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalise(text: Column) -> Column:
    return squeeze(fold(text))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def formless(text: Column) -> Column:
    """Folded, with every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def summary_key(text: Column) -> Column:
    """What two copies of a summary have in common: no leading label, one space, lower case; accents stay."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^ementa\s*:\s*", ""), SPACE + "+", " "))


def words(text: Column) -> Column:
    """Words that count for scoring: letters and digits of the folded text, three or more, no stop words."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(sorted(STOP_WORDS)))


def fold_plain(text: str) -> str:
    """`fold` on the driver, for query terms."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)


def normalise_plain(text: str) -> str:
    return re.sub(r"\s+", " ", fold_plain(text)).strip()


def once(value: Column, condition) -> Column:
    """condition(value) with the value computed once, even where the optimiser would copy its expression into a filter."""
    return F.exists(F.array(value), condition)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once a row: a bound variable is not copied by the optimiser."""
    return F.transform(F.array(value), use)[0]


@dataclass(frozen=True)
class Stem:
    """One word of a formulation: a text has it if the pattern is found. re2 is the same without look-around."""

    key: str
    java: str
    re2: str
    roots: tuple[str, ...]

    def within(self, folded: Column) -> Column:
        """Whether a folded text has the word; the plain search that the pattern implies goes first."""
        return reduce(lambda a, b: a | b, (folded.contains(r) for r in self.roots)) & folded.rlike(self.java)


def stems(formulation: str) -> list[Stem]:
    """The different stems of a formulation.

    A word under STEM letters stands for itself and its plural; a longer one for all words that begin
    with its first STEM letters, with or without a negating in- or im- before them.
    """
    out: dict[str, Stem] = {}
    for w in re.split("[^a-z0-9]+", fold_plain(formulation)):
        if len(w) < 3 or w in STOP_WORDS:
            continue
        if len(w) < STEM:
            key = w[:-1] if len(w) > 3 and w.endswith("s") else w
            roots, body, after = [key], f"{key}s?", True
        else:
            key = w[:STEM]
            roots = [key] + ([w[2 : 2 + STEM]] if re.match("i[mn]", w) and len(w) >= STEM + 2 else [])
            body, after = f"(?:i[mn])?(?:{'|'.join(roots)})", False
        start = "(?:^|[^a-z0-9])"
        out.setdefault(key, Stem(key, start + body + ("(?![a-z0-9])" if after else ""), start + body + ("(?:[^a-z0-9]|$)" if after else ""), tuple(roots)))
    return list(out.values())


def adherence(folded: Column, formulations: list[str]) -> Column:
    """Best share, over the formulations, of a formulation's stems that a folded text has."""
    shares = [sum((s.within(folded).cast("int") for s in known), F.lit(0)) / F.lit(len(known)) for known in map(stems, formulations) if known]
    if not shares:
        return F.lit(0.0)
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def expression(term: str) -> str:
    """Java pattern of a whole expression over normalised text: no letter or digit glued to it."""
    return rf"(?<![\p{{L}}\p{{N}}]){re.sub(r'([.*+?^${}()|\[\]\\])', r'\\\1', normalise_plain(term))}(?![\p{{L}}\p{{N}}])"


def expression_re2(term: str) -> str:
    """The same for engines without look-around; good for finding, not for counting."""
    return rf"(?:^|[^\p{{L}}\p{{N}}]){re.sub(r'([.*+?^${}()|\[\]\\])', r'\\\1', normalise_plain(term))}(?:[^\p{{L}}\p{{N}}]|$)"


# The four readings of a summary that stops in the middle.
SITE_FOOTER = r"\n\s*\n\s*\([^\n]*\)\s*$"
LOOSE_ITEM = r"[.;:!?]\s+(?:[IVXLC]+|\d{1,3})[.)]$"
SENTENCE_END = r"[.!?…\"”»)\]]$"
SIGNATURE = r"(?i)\n[^\n]{0,60}\b(?:relatora?|desembargadora?|juiz|juíza|ministr[oa])\s*$"


def seems_cut(text: Column) -> Column:
    """Whether a summary seems to stop in the middle of a sentence."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, SITE_FOOTER, ""), r"^\s+|\s+$", ""))
    return (body != "") & (body.rlike(LOOSE_ITEM) | (~body.rlike(SENTENCE_END) & ~body.rlike(SIGNATURE)))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def mended(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text as it is."""
    again = F.decode(F.encode(F.regexp_replace(text, "[^\u0000-ÿ]", "?"), "ISO-8859-1"), "UTF-8")
    fits = ~text.rlike("[^\u0000-ÿ]") & text.rlike("[Â-ô][\u0080-¿]") & ~text.rlike("[Â-ô](?![\u0080-¿])") & ~text.rlike("(?<![\u0080-ÿ])[\u0080-¿]")
    return F.when(fits, again).otherwise(text)


# What is taken out of an outside party's text, and what stands for it.
TAKEN_OUT = (
    (r"<[^>]*>", " "),
    (r"(?i)https?://\S+|www\.\S+", "[endereço retirado]"),
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[e-mail retirado]"),
    (r"\d[\d.\-/]{9,}\d", "[número retirado]"),
    (r"(?<![\w-])(?=[\w-]*\d)(?=[\w-]*[A-Za-z])[\w-]{20,}(?![\w-])", "[código retirado]"),
    (r"[`<>{}\x00-\x1f\x7f]", " "),
)


def cleaned(text: Column, most: int = 200) -> Column:
    """Text of an outside party for a report: no tags, addresses, long numbers or codes (letters and digits), bounded."""
    out = text
    for pattern, mark in TAKEN_OUT:
        out = F.regexp_replace(out, pattern, mark)
    return _bound_length(squeeze(out), most)


def _bound_length(text: Column, most: int) -> Column:
    return bound(text, lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t))


#: Block tags that end a line.
BLOCK_TAGS = "address|article|aside|blockquote|body|br|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul"
#: Character references of markup and white space, decoded inside the JVM.
REFERENCES = (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: Any reference, by name or number.
ANY_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _character(reference: Column) -> Column:
    """What a reference stands for; one of no known name, or of no character, stays."""
    number = F.when(reference.rlike("^&#[xX]"), F.conv(F.substring(reference, 4, 6), 16, 10)).when(reference.startswith("&#"), F.regexp_extract(reference, "[0-9]+", 0)).cast("int")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    named = F.map_from_arrays(F.lit(sorted(name2codepoint)), F.lit([chr(name2codepoint[n]) for n in sorted(name2codepoint)]))
    name = F.regexp_replace(reference, "[&;]", "")
    return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")), F.when(name == "apos", "'"), named[name], reference)


def _decoded(text: Column) -> Column:
    """Character references decoded once, left to right; texts with the usual ones only take the short way."""
    plain = text
    for name, char in REFERENCES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    known = "|".join(name[1:-1] for name, _ in REFERENCES)
    other = text.rlike(rf"&(?!(?:{known});)(?:#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z][A-Za-z0-9]+;)")
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(ANY_REFERENCE), F.lit(0)), _character), F.array(F.lit("")))
    return F.when(other, F.array_join(F.zip_with(F.split(text, ANY_REFERENCE, -1), found, lambda piece, char: F.concat(piece, char)), "")).otherwise(plain)


def html_text(source: Column) -> Column:
    """Readable text of an HTML page: scripts and comments go, block tags break lines, spaces are squeezed."""
    out = F.regexp_replace(source, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"[\r\n]+", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    # bound, so the steps before are made once a row
    out = bound(out, _decoded)
    out = F.regexp_replace(out, r"[ \t\u00a0]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"^\s+|\s+$|(?<=\n)\n+", "")
