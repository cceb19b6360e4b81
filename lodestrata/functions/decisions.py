"""The parts of a decision: sections, sentences, quotes, the summary alone, the class it gives itself.

All are column expressions inside the JVM. Places are code points, from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import bound, cleaned, digits, fold, normalise

# The titles that open a section, and the section.
SECTIONS = {
    "EMENTA": "ementa",
    "ACÓRDÃO": "acórdão",
    "RELATÓRIO": "relatório",
    "VOTO": "voto",
    "VOTO VISTA": "voto-vista",
    "VOTO VENCIDO": "voto vencido",
    "VOTO VOGAL": "voto vogal",
    "CERTIDÃO": "certidão",
    "CERTIDÃO DE JULGAMENTO": "certidão",
}
LONGEST_TITLE = 80
#: Inside these, a title of a summary or a decision is one that is quoted.
QUOTING = ("relatório", "voto vencido")
QUOTED = ("ementa", "acórdão")


def _section(title: Column) -> Column:
    """The section that a trimmed line opens; null for any other line."""
    plain = {k.replace(" ", ""): v for k, v in SECTIONS.items()}
    names = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
    line = F.regexp_replace(title, r"\s*:$", "")
    capitals = line.rlike(r"^[\p{Lu}\s-]+$")
    bare = F.regexp_replace(F.upper(line), r"[\s-]+", "")
    known = F.when(capitals | line.rlike(r"^\p{Lu}[\p{Ll}\s-]+$"), names[bare])
    return F.coalesce(known, F.when(capitals & bare.startswith("VOTOVENCIDO"), F.lit("voto vencido")))


def section_titles(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, section, title: the lines that are a title, in capitals or with one capital, letters spaced or not.

    Only texts with such a line leave their row. A summary's or decision's title stands inside a report or a
    dissent when the last other title before it opened one; such titles are left out. `key` tells texts apart.
    """
    lines = F.split(F.col(text), "\n", -1)
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    hopeful = F.exists(lines, lambda x: (F.length(x) <= LONGEST_TITLE) & _section(trimmed(x)).isNotNull())
    some = rows.where(hopeful).select(key, F.posexplode(lines).alias("_n", "_line"))
    at = F.sum(F.length("_line") + 1).over(Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    placed = some.select(key, F.coalesce(at, F.lit(0)).cast("long").alias("start"), F.length("_line").alias("_long"), trimmed(F.col("_line")).alias("title"))
    titles = placed.where(F.col("_long") <= LONGEST_TITLE).withColumn("section", _section(F.col("title"))).where("section is not null")
    before = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last(F.when(~F.col("section").isin(*QUOTED), F.col("section")), ignorenulls=True).over(before)
    kept = titles.withColumn("_in", inside).where(~F.col("section").isin(*QUOTED) | ~F.coalesce(F.col("_in").isin(*QUOTING), F.lit(False)))
    return kept.select(key, "start", "section", "title")


# Short forms whose point ends no sentence.
SHORT_FORMS = (
    "art arts inc incs al fl fls p pp pág págs rel min des desa dr dra sr sra exmo exma cf ob op cit n nº v vol ed "
    "julg publ dj dje proc sec cap par parág ag resp agrg agint edcl ex obs"
).split(" ")
_SHORT = rf"(?iu:{'|'.join(SHORT_FORMS)}|\p{{L}})"
#: White space between two sentences: a line break, or what follows . ! ? before a capital or the number of an item,
#: unless the point ends a short form, or an item's number that no short form stands before.
BETWEEN_SENTENCES = (
    r"\s*\n\s*|(?<=[.!?])"
    rf"(?<!(?:^|\s)[(\"“«\[]{{0,4}}{_SHORT}[.!?])"
    rf"(?:(?<!(?:^|\s)[(\"“«\[]{{0,4}}\d{{1,9}}[.!?])|(?<=(?:^|\s)[(\"“«\[]{{0,4}}{_SHORT}\.\s{{1,4}}[(\"“«\[]{{0,4}}\d{{1,9}}[.!?]))"
    r"[^\S\n]+(?=\p{Lu}|\d{1,9}[.)]\s)"
)


def sentences(text: Column) -> Column:
    """The sentences of a text in order, trimmed; none of an empty text."""
    return F.filter(F.transform(F.split(text, BETWEEN_SENTENCES, -1), F.trim), lambda s: s != "")


def sentences_at(text: Column, start: Column, end: Column) -> Column:
    """What the sentences that [start, end) touches are, as one slice of the text."""
    pieces = F.split(text, BETWEEN_SENTENCES, -1)
    gaps = F.concat(F.regexp_extract_all(text, F.lit(BETWEEN_SENTENCES), F.lit(0)), F.array(F.lit("")))
    spans = F.zip_with(pieces, gaps, lambda p, g: F.struct(F.length(p).alias("n"), F.length(g).alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("a"), F.lit(-1).alias("b"))

    def step(s: Column, x: Column) -> Column:
        stop = s["at"] + x["n"]
        return F.struct(
            (stop + x["g"]).alias("at"),
            F.when(s["at"] <= start, s["at"]).otherwise(s["a"]).alias("a"),
            F.when((s["b"] < 0) & (stop + x["g"] >= end), stop).otherwise(s["b"]).alias("b"),
        )

    return bound(F.aggregate(spans, zero, step), lambda s: F.trim(F.substring(text, s["a"] + 1, F.when(s["b"] < 0, F.length(text)).otherwise(s["b"]) - s["a"])))


_OPENS = r"[“«]|(?<![^\s(\[{—–-])\""
_MARKS = rf"({_OPENS})|[”»]|(?<!\d)\""


def quoted(text: Column, start: Column, end: Column) -> Column:
    """Whether [start, end) begins inside open quotes, or has an opening one in it. A straight mark after a digit closes nothing."""
    events = lambda n: F.regexp_extract_all(F.substring(text, F.lit(1), n.cast("int")), F.lit(_MARKS), F.lit(1))
    openings = lambda e: F.size(F.filter(e, lambda m: m != ""))
    return bound(F.struct(events(start).alias("a"), events(end).alias("b")), lambda e: (F.coalesce(F.try_element_at(e["a"], F.lit(-1)), F.lit("")) != "") | (openings(e["b"]) > openings(e["a"])))


# Courts whose field has the head of the process before the summary, and the marks of its parts.
WITH_HEAD = ("tjba", "tjpe", "tjmt", "tjpb")
LONGEST_HEAD, START_SHOWN = 1500, 600
PARTY = r"(?i:\b(?:apelante|apelad[oa]|recorrente|recorrid[oa]|agravante|agravad[oa]|embargante|embargad[oa]|impetrante|impetrad[oa]|requerente|requerid[oa])(?:\s*\([^)]{1,3}\))?\s*:)"
SUMMARY_MARK = r"(?:\bEMENTA\b|\bEmenta\s*:|E M E N T A)"
DECISION_MARK = r"\bAC[OÓ]RD[AÃ]O\s+(?!Vistos\b)"
COURT_HEAD = r"^(?:EMENTA\s*:\s*)?PODER\s+JUDICI[AÁ]RIO\b"
SUMMARY_END = r"\sRELATÓRIO\s|\sACÓRDÃO\s+Vistos\b"
CLOSING = r"\sVistos,?\s+relatados\s+e\s+discutidos(?=\s{1,3}(?:estes|os\s+presentes)\s+autos\b)"
TITLE = r"\b(?:RELAT[ÓO]RIO|VOTO)(?:\s*[:.–—-]|\s+[A-ZÀ-Ý][a-zà-ÿ])|\bACORDAM\b|\bACÓRDÃO\s+Vistos\b|(?i:\b(?:relat[óo]rio|voto)\s*:)"


def _reach(text: Column, pattern: str) -> Column:
    """How long the shortest start of a text is that ends with the pattern; null without one."""
    return F.nullif(F.length(F.regexp_extract(text, rf"(?s)^.*?(?:{pattern})", 0)), F.lit(0))


def _after(text: Column, place: Column, pattern: str) -> Column:
    """struct(start, end) of the first match at `place` or later, where both are known."""
    rest = F.substring(text, place + 1, F.length(text))
    before = F.regexp_extract(rest, rf"(?s)^(.*?)(?:{pattern})", 1)
    return F.struct((place + F.length(F.when(rest.rlike(pattern), before))).alias("start"), (place + _reach(rest, pattern)).alias("end"))


def _start_of(text: Column) -> Column:
    return F.when(F.length(text) <= START_SHOWN, text).otherwise(F.regexp_replace(F.substring(text, 1, START_SHOWN), r"\s+\S*$", ""))


def summary_alone(court: Column, field: Column) -> Column:
    """struct(summary, note) of a field that may hold the head of the process and the whole decision.

    note: header, header_and_close, whole_decision, start_only (the parts can't be told apart, so only the start is
    given) or null (the field is as it was). The summary is always one slice of the field.
    """
    text = F.regexp_replace(field, r"^\s+|\s+$", "")

    def begin(h: Column) -> Column:
        plain = _after(h, _reach(h, PARTY), SUMMARY_MARK)
        card = F.when((court == "tjba") & h.rlike(COURT_HEAD), F.greatest(_reach(h, rf"(?:(?!{PARTY}).)*{PARTY}.*?{PARTY}"), _reach(h, r"\bProcesso\s*:")))
        card = F.when(_reach(h, r"\bProcesso\s*:").isNotNull() & _reach(h, rf"{PARTY}.*?{PARTY}").isNotNull(), card)
        by_card = _after(h, card, DECISION_MARK)
        a = F.when(plain["start"] <= LONGEST_HEAD, F.struct(plain["start"].alias("at"), plain["start"].alias("from")))
        b = F.when(by_card["start"] <= LONGEST_HEAD, F.struct(by_card["start"].alias("at"), by_card["end"].alias("from")))
        return F.least(a, b)["from"]

    start_only = lambda c: F.struct(_start_of(c).alias("summary"), F.lit("start_only").alias("note"))
    as_it_was = F.struct(field.alias("summary"), F.lit(None).cast("string").alias("note"))

    def end_of(rest: Column) -> Column:
        end = _after(rest, F.lit(0), SUMMARY_END)["start"]
        closing = F.struct(F.regexp_extract(rest, rf"(?s)^(.*){CLOSING}", 1).alias("before"), F.regexp_extract(rest, rf"(?s)^.*{CLOSING}(.*)$", 1).alias("after"))
        confirmed = bound(closing, lambda c: F.when((c["before"] != "") & c["after"].rlike(r"(?i)\bAcordam\b") & c["after"].rlike(r"\(\s*Classe\s*:"), F.length(c["before"])))
        return F.when(court == "tjba", F.coalesce(end, confirmed))

    def told_apart(s: Column) -> Column:
        report = F.substring(s["rest"], s["cut"] + 1, F.lit(12)).contains("RELATÓRIO")
        note = F.when(s["cut"].isNull(), "header").when(report, "whole_decision").otherwise("header_and_close")
        summary = F.regexp_replace(F.substring(s["rest"], F.lit(1), F.coalesce(s["cut"], F.length(s["rest"]))), r"\s+$", "")
        checked = bound(summary, lambda c: F.when(c.rlike(TITLE), start_only(c)).otherwise(F.struct(c.alias("summary"), note.alias("note"))))
        return F.when((court == "tjba") & s["cut"].isNull(), start_only(s["rest"])).otherwise(checked)

    def parts(s: Column) -> Column:
        whole = F.when(s["text"].rlike(TITLE), start_only(s["text"])).otherwise(as_it_was)
        rest = F.substring(s["text"], s["from"] + 1, F.length(s["text"]))
        return F.when(s["from"].isNull(), whole).otherwise(bound(rest, lambda r: bound(F.struct(r.alias("rest"), end_of(r).alias("cut")), told_apart)))

    read = bound(text, lambda x: F.struct(x.alias("text"), bound(F.substring(x, 1, LONGEST_HEAD + 60), begin).alias("from")))
    return F.when(court.isin(*WITH_HEAD) & field.isNotNull(), bound(read, parts)).otherwise(as_it_was)


# Names of judging bodies, the classes of appeal, and their short forms.
BODY_NAME = r"^(?:(?:\d+\s*[ªºa°o]?|primeira|segunda|terceira|quarta|quinta|sexta|setima|oitava|nona|decima|unica)\s+)?(?:turma|camara|secao|plenario|pleno|tribunal pleno|orgao especial|corte especial|vara|juizado|gabinete|colegio recursal)\b"
APPEALS = (
    "apelacao civel", "apelacao criminal", "apelacao", "agravo de instrumento", "agravo interno", "agravo regimental",
    "agravo em recurso especial", "agravo em recurso extraordinario", "embargos de declaracao", "embargos infringentes",
    "embargos de divergencia", "recurso inominado", "recurso especial", "recurso extraordinario",
    "recurso em sentido estrito", "remessa necessaria",
)
APPEAL_SHORT = {
    "agravo interno": ("agint", r"ag\.?\s*interno", r"agr\.?\s*interno", r"agravo\s+int\."),
    "agravo regimental": ("agrg", r"ag\.?\s*regimental", r"agr\.?\s*reg\."),
    "agravo de instrumento": ("ai", "agi", r"ag\.?\s*(?:de\s+)?instrumento"),
    "agravo em recurso especial": ("aresp", "agresp"),
    "agravo em recurso extraordinario": ("are", "agre"),
    "embargos de declaracao": ("edcl", "ed", r"emb\.?\s*(?:de\s+)?decl", "declaratorios"),
    "embargos infringentes": ("ei", r"emb\.?\s*infr"),
    "embargos de divergencia": ("eresp", "earesp", "ediv", "edv"),
    "recurso inominado": ("ri", r"rec\.?\s*inominado"),
    "recurso especial": ("resp",),
    "recurso extraordinario": ("re", "rext"),
    "recurso em sentido estrito": ("rese", "rse"),
    "remessa necessaria": ("reexame", r"remessa\s+oficial"),
    "apelacao": ("ap", "apl", "apc", "apciv", "apcrim", "apelo"),
    "agravo": ("ag", "agint", "agrg", "aresp", "are", "ai", "agi"),
    "embargos": ("ed", "edcl", "ei", "eresp", r"emb\."),
}
SUMMARY_EDGE = 300


def _spaced(name: str) -> str:
    return name.replace(" ", r"\s+")


def class_doubt(class_: Column, summary: Column, number: Column) -> Column:
    """struct(kind, named): `body` where the class field names a judging body; `summary` where the summary says it is
    another class of appeal than the field does, which it nowhere names; nulls where nothing is written against it.

    A summary says its own class as a whole item of its title, or in brackets at its end before its process number.
    """
    main = normalise(F.element_at(F.split(F.trim(class_), r"(?i)\s+em\s+", 2), 1))
    short = lambda name: APPEAL_SHORT.get("apelacao" if name.startswith("apelacao") else name, ())
    forms = {name: rf"(?<![a-z0-9])(?:{'|'.join((_spaced(name), *short(name)))})(?![a-z0-9])" for name in (*APPEALS, "agravo", "embargos")}
    by_class = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    appeal = rf"\b(?:{'|'.join(map(_spaced, sorted(APPEALS, key=len, reverse=True)))})\b"
    item = rf"(?:^|[.;–—]|\s-\s)\s*(?:ementa\s*:\s*)?(?:recurso\s+de\s+)?({appeal})\s*(?:[.;:–—]|\s-\s)"
    last = rf"\(\s*(?:tj-?[a-z]{{2}},\s*)?({appeal})\s*(?:-|,|n[º°o.]*)?\s*([\d.\-]{{20,25}})"

    def doubt(s: Column) -> Column:
        title = F.regexp_extract(F.regexp_replace(F.substring(s["plain"], 1, SUMMARY_EDGE), r"\([^()]*(?:\)|$)", "()"), item, 1)
        edge = F.when(F.length(s["plain"]) > SUMMARY_EDGE, F.substring(s["plain"], -SUMMARY_EDGE, SUMMARY_EDGE)).otherwise(s["plain"])
        pairs = F.arrays_zip(F.regexp_extract_all(edge, F.lit(last), F.lit(1)).alias("c"), F.regexp_extract_all(edge, F.lit(last), F.lit(2)).alias("n"))
        own = F.filter(pairs, lambda p: (F.length(s["digits"]) == 20) & (digits(p["n"]) == s["digits"]))
        named = F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.try_element_at(own, F.lit(1))["c"]), r"\s+", " ")
        written = F.coalesce(F.regexp_like(s["plain"], by_class[s["main"]]), F.lit(True))
        against = ~written & named.isNotNull() & ~named.startswith(s["main"]) & ~s["main"].startswith(named)
        none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("named"))
        body = F.struct(F.lit("body").alias("kind"), F.lit(None).cast("string").alias("named"))
        return F.when(s["class"].rlike(BODY_NAME), body).when(against, F.struct(F.lit("summary").alias("kind"), named.alias("named"))).otherwise(none)

    read = F.struct(main.alias("main"), normalise(class_).alias("class"), fold(F.coalesce(summary, F.lit(""))).alias("plain"), F.coalesce(digits(number), F.lit("")).alias("digits"))
    return bound(read, doubt)


# What a notice must not give away, and what stands for it.
PERSON_LINE = r"(?i)\b(?:apelante|apelado|agravante|agravado|embargante|embargado|recorrente|recorrido|impetrante|impetrado|autor|autora|r[ée]u|requerente|requerido|interessado|advogad[oa]s?(?:\(as?\))?|procurador(?:a)?|relator(?:a)?|revisor(?:a)?)\b[^\n]{0,20}:"
PROCESS_NUMBER = r"\d{7}-?\d{2}\.?\d{4}\.?\d\.?\d{2}\.?\d{4}"
NOTICE_MASKS = (
    (r"\b\d{3}[.\s]?\d{3}[.\s]?\d{3}[-\s]?\d{2}\b", "[número retirado]"),
    (r"\(?\d{2}\)?\s?9?\d{4}-?\d{4}", "[telefone retirado]"),
    (r"\b\d{2}\.?\d{3}-\d{3}\b", "[CEP retirado]"),
    (r"(?i)OAB[\s/.-]*[A-Z]{0,2}[\s/.-]*\d[\d.]*", "[OAB retirada]"),
)
LOOKS_QUOTED = r"(?i)\b(?:transcri\w*|precedente|in verbis|ata|pauta|RELAT[ÓO]RIO|VOTO)\b"
LOOKS_NAMED = r"[\"“”«»]|(?<![A-Za-zÀ-ÿ])[A-ZÀ-Ý][a-zà-ÿ]+\s+(?:(?:de|da|do|dos|das)\s+)?[A-ZÀ-Ý][a-zà-ÿ]+(?![A-Za-zÀ-ÿ])"
NOTICE_SHOWN = 600


def notice_excerpt(kind: Column, text: Column, number: Column, names: Column) -> Column:
    """The summary in a notice, without people and numbers of people; null (not verified) on any doubt.

    It takes two signs: the kind says it is a decision, and the text has one summary, one decision after it and no
    process number but the one asked for. names: people the notice itself declares; none of them may be left.
    """
    head, tail = r"(?im)^EMENTA\s*[:.\-–]\s*", r"(?im)^AC[ÓO]RD[ÃA]O\s*:"
    count = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    own = digits(number)
    cited = F.transform(F.regexp_extract_all(text, F.lit(PROCESS_NUMBER), F.lit(0)), digits)
    before = F.element_at(F.split(text, head, 2), 1)
    inside = F.regexp_extract(text, r"(?ims)^EMENTA\s*[:.\-–]\s*(.*?)^AC[ÓO]RD[ÃA]O\s*:", 1)
    alone = (count(text, r"(?i)\bEMENTA\b") == 1) & (count(text, head) == 1) & (count(text, tail) == 1) & (inside != "")
    same = (F.length(own) == 20) & (F.size(cited) > 0) & F.forall(cited, lambda n: n == own) & before.rlike(PROCESS_NUMBER)
    sure = (kind == "Acórdão") & alone & same & ~text.rlike(LOOKS_QUOTED) & (count(text, r"(?i)\b(?:ACORDAM|DECIDEM)\b") <= 1)
    lines = F.array_join(F.filter(F.split(inside, "\n"), lambda x: ~x.rlike(PERSON_LINE)), " ")

    def shown(body: Column) -> Column:
        declared = F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNull() | (F.trim(n) == "") | F.lower(body).contains(F.lower(F.trim(n))))
        masked = reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), NOTICE_MASKS, body)
        return F.when(~declared & ~body.rlike(LOOKS_NAMED), F.nullif(cleaned(masked, NOTICE_SHOWN), F.lit("")))

    return F.when(sure, bound(lines, shown))


# The months as a page writes them.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def updated_at(text: Column) -> Column:
    """"Última Atualização outubro 8, 2026, 17:25 (UTC)" as an instant; any other form is null."""
    shape = r"^Última Atualização (\p{L}+) (\d{1,2}), (\d{4}), (\d{2}):(\d{2}) \(UTC\)$"
    part = lambda n: F.regexp_extract(text, shape, n)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(1))
    written = F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0"))
    return F.when(text.rlike(shape) & (month > 0), F.try_to_timestamp(F.concat(written, F.lit(" "), part(4), F.lit(":"), part(5)), F.lit("yyyy-MM-dd HH:mm")))


def coverage_state(came: Column, asked: Column, ceiling: Column) -> Column:
    """What a number of records says of a base whose total is not told: few_per_search, exhausted or may_have_more."""
    return F.when((came < asked) & (ceiling < 100), "few_per_search").when(came < asked, "exhausted").otherwise("may_have_more")


def json_cost(*columns: Column) -> Column:
    """How many characters a row takes as compact JSON."""
    return F.length(F.to_json(F.struct(*columns)))
