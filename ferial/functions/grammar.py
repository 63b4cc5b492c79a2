"""Compact citation and calendar grammars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferial.functions.text import clean, clean_inline, lines

# fixed values: suffixes of a calendar name and the ranks they stand for
RANKS = (("PF", "principal_feast"), ("HD", "holy_day"), ("Mem", "memorial"), ("Com", "commemoration"))
_WEEKDAYS = "Sunday|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday"


def _case(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def _lit_or_null(c: Column) -> Column:
    return F.when(c != "", c)


# calendar names


def name_meta(line: Column) -> Column:
    """``struct(name, rank, colour)`` of ``Name - RANK (Colour) [note]``; a Sunday without rank is a holy day, else a feria."""
    colour = _lit_or_null(F.regexp_extract(line, r"\(([^()]*)\)[^()]*$", 1))
    body = F.trim(F.regexp_extract(F.regexp_replace(line, r"\s*\([^()]*\)(?=[^()]*$)", ""), r"(?s)^([^\[]*)", 1))
    ranked = [(body.endswith(f" - {mark}"), F.lit(rank)) for mark, rank in RANKS]
    rank = _case(ranked, F.when(F.lower(body).contains("sunday"), F.lit("holy_day")).otherwise(F.lit("feria")))
    name = F.trim(F.regexp_replace(body, r" - (?:PF|HD|Mem|Com)$", ""))
    return F.struct(name.alias("name"), rank.alias("rank"), colour.alias("colour"))


def title_meta(raw: Column) -> Column:
    """Titles of scraped pages: a rank suffix, a rank in parentheses, a colour before it, or neither."""
    rank_word = F.regexp_extract(raw, r"\b(PF|HD|Mem|Com)\b", 1)
    rank = _case([(rank_word == m, F.lit(r)) for m, r in RANKS], F.when(raw.rlike(rf"^(?:{_WEEKDAYS})\b"), F.lit("feria")).otherwise(F.lit("holy_day")))
    colour = _lit_or_null(F.regexp_extract(raw, r"\(([A-Z][a-z]+(?: or [A-Z][a-z]+)*)\)", 1))
    colour = F.when(colour.isin(*[m for m, _ in RANKS]), None).otherwise(colour)
    name = F.trim(F.regexp_extract(raw, r"^(.*?)(?:\s+-\s+(?:PF|HD|Mem|Com)\b.*|\s*\(.*)?$", 1))
    return F.struct(name.alias("name"), rank.alias("rank"), colour.alias("colour"))


def observance_lines(raw: Column) -> Column:
    """The lines of a name field; one line that joins two ranked observances by `` and `` is two."""
    joined = r"( - (?:PF|HD|Mem|Com)(?: \([^()]*\))?) and (?=[^\n]* - (?:PF|HD|Mem|Com)\b)"
    return F.filter(F.transform(lines(F.regexp_replace(clean(raw), joined, "$1\n")), lambda x: F.trim(x)), lambda x: x != "")


def commemorations(raw: Column) -> Column:
    """Ranked lines below the first, with whether rank and colour equal the day's."""
    own = observance_lines(raw)
    day = name_meta(F.try_element_at(own, F.lit(1)))
    below = F.filter(F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda x: x.rlike(r" - (?:PF|HD|Mem|Com)\b"))
    return F.transform(
        below,
        lambda x: F.struct(
            name_meta(x).getField("name").alias("name"),
            name_meta(x).getField("rank").alias("rank"),
            name_meta(x).getField("colour").alias("colour"),
            (name_meta(x).getField("rank").eqNullSafe(day.getField("rank")) & name_meta(x).getField("colour").eqNullSafe(day.getField("colour"))).alias("coequal"),
        ),
    )


def commemoration_join(raw: Column, words: dict[str, str]) -> Column:
    """The word that joins names of equal standing, from the line that states it (``words``: line in lower case, word); null where
    no commemoration is of equal standing or no line states one."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    said = F.transform(observance_lines(raw), lambda x: F.try_element_at(table, F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))))
    return F.when(F.exists(commemorations(raw), lambda c: c["coequal"]), F.try_element_at(F.filter(said, lambda w: w.isNotNull()), F.lit(1)))


def eve_target(line: Column) -> Column:
    """What an ``Eve of [the] X`` line is the eve of, lower case and without rank or article."""
    target = F.lower(name_meta(line).getField("name"))
    return _lit_or_null(F.regexp_extract(target, r"^eve of (?:the )?(.+)$", 1))


# offices


def office_branches(raw: Column) -> Column:
    """The primary branch and the alternates, each after a line that is only ``Or``."""
    return F.transform(F.split(clean(raw), r"(?:^|\n)Or[^\S\n]*(?=\n|$)", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))


def office_fields(branch: Column, divider: str = r"[;\n]") -> Column:
    """``struct(lessons_pick, label, rubric, psalms, year_note, collect, lessons)`` of one branch.

    Only the first ``Ps`` field holds psalms; a later one is a lesson. ``Coll above`` and the like are no lessons.
    """
    multi = r"(?i)two of the following (?:\w+ )?readings:"
    text = F.trim(F.regexp_replace(branch, multi, ""))
    prefix = F.when(~text.startswith("Ps "), _lit_or_null(F.regexp_extract(text, r"^([^:;\n0-9]+):\s", 1)))
    named = ~F.exists(F.split(prefix, r"\s+"), lambda w: w.rlike(r"^[a-zà-ÿ]") & ~F.lower(w).isin("of", "the", "and", "or", "de", "du", "in"))
    body = F.when(prefix.isNull(), text).otherwise(F.trim(F.substr(text, F.length(prefix) + 2)))
    fields = F.filter(F.transform(F.split(body, divider), lambda x: F.trim(x)), lambda x: x != "")
    is_ps = lambda x: F.regexp_replace(x, r"^\(Year \d+\)\s*", "").startswith("Ps ")
    first = F.try_element_at(F.filter(fields, is_ps), F.lit(1))
    collect = F.try_element_at(F.filter(fields, lambda x: x.rlike(r"^Coll\s")), F.lit(-1))
    at = F.array_position(fields, F.coalesce(first, F.lit("")))
    lessons = F.filter(fields, lambda x, i: ~x.rlike(r"^Coll\b|^O Antiphon|^Preface of") & ~((i + 1 == at) & (at > 0)))
    return F.struct(
        F.when(branch.rlike(multi), 2).alias("lessons_pick"),
        F.when(named, prefix).alias("label"),
        F.when(~named, prefix).alias("rubric"),
        F.regexp_replace(first, r"^\(Year \d+\)\s*", "").alias("psalms"),
        _lit_or_null(F.regexp_extract(F.coalesce(first, F.lit("")), r"^\(Year (\d+)\)", 1)).alias("year_note"),
        _lit_or_null(F.trim(F.regexp_replace(F.coalesce(collect, F.lit("")), r"^Coll\s+", ""))).alias("collect"),
        F.transform(lessons, repair_lesson).alias("lessons"),
    )


def repair_lesson(c: Column) -> Column:
    """``struct(citation, optional)``; ``Mt: 22:23`` and ``Gal 4.21`` repaired."""
    optional = c.rlike(r"^\(.*\)$")
    body = F.when(optional, F.regexp_replace(c, r"^\(|\)$", "")).otherwise(c)
    fixed = F.regexp_replace(F.regexp_replace(body, r"^([1-4]? ?[A-Za-z]+): (?=\d)", "$1 "), r"(\d)\.(\d)", "$1:$2")
    return F.struct(fixed.alias("citation"), optional.alias("optional"))


def psalm_sets(field: Column) -> Column:
    """One or two lists of tokens: a psalm field's choices around its first `` or ``."""
    body = F.when(field.startswith("Ps "), F.substr(field, F.lit(4)))
    return F.split(body, " or ", 2)


def psalm_entries(tokens: Column) -> Column:
    """``array<struct(num, first, last, optional)>`` of a comma list, by a fold that carries the psalm's number on.

    ``N:a-b`` sets the number; a bare range or an optional bare number after it continues the same psalm.
    """
    entry = "struct<num:int,first:int,last:int,optional:boolean>"
    start = F.struct(F.lit(None).cast("int").alias("cur"), F.expr(f"cast(array() as array<{entry}>)").alias("out"))

    def step(acc: Column, raw: Column) -> Column:
        t = F.trim(raw)
        optional = t.rlike(r"^[(\[].*[)\]]$")
        c = F.regexp_replace(t, r"^[(\[]|[)\]]$", "")
        has = c.contains(":")
        num = F.expr("0")
        num = F.when(has, F.regexp_extract(c, r"^(\d+):", 1)).otherwise("").try_cast("int")
        span = F.when(has, F.regexp_replace(c, r"^\d+:", "")).otherwise(c)
        goes_on = ~has & acc["cur"].isNotNull() & (c.contains("-") | optional) & span.rlike(r"^\d+(?:-\d+)?$")
        whole = ~has & ~goes_on
        a = F.when(whole, None).otherwise(F.regexp_extract(span, r"^(\d+)", 1)).try_cast("int")
        b = F.when(whole, None).otherwise(F.coalesce(_lit_or_null(F.regexp_extract(span, r"-(\d+)$", 1)), F.regexp_extract(span, r"^(\d+)", 1))).try_cast("int")
        n = F.when(has, num).when(goes_on, acc["cur"]).otherwise(F.regexp_extract(c, r"^(\d+)", 1).try_cast("int"))
        item = F.struct(n.alias("num"), a.alias("first"), b.alias("last"), optional.alias("optional"))
        return F.struct(F.coalesce(num, acc["cur"]).alias("cur"), F.concat(acc["out"], F.array(item)).alias("out"))

    pieces = F.filter(F.split(tokens, ", "), lambda x: F.trim(x) != "")
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def psalm_citations(tokens: Column) -> Column:
    """``array<struct(citation, optional, omit)>`` of a comma list: neighbours of one psalm become one citation with the parenthesised spans
    in ``omit`` where there are such spans, else each stands for itself, a continuation with its psalm's number.

    A list in square brackets is all optional and merges nothing.
    """
    shape = "struct<num:int,first:int,last:int,optional:boolean,raw:string>"
    none = F.expr("cast(array() as array<string>)")
    whole = F.trim(tokens).rlike(r"^\[.*\]$")
    pieces = F.filter(F.split(tokens, ", "), lambda x: F.trim(x) != "")

    def named(e: Column, t: Column) -> Column:
        bare = F.regexp_replace(F.trim(t), r"^[(\[]|[)\]]$", "")
        return F.struct(e["num"].alias("num"), e["first"].alias("first"), e["last"].alias("last"), e["optional"].alias("optional"), F.when(e["first"].isNotNull(), _verses(e["num"], e["first"], e["last"])).otherwise(bare).alias("raw"))

    entries = F.zip_with(psalm_entries(tokens), pieces, named)
    start = F.expr(f"cast(array() as array<array<{shape}>>)")

    def collect(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        previous = F.try_element_at(last, F.lit(-1))
        joins = F.coalesce(e["first"].isNotNull() & previous["first"].isNotNull() & (e["num"] == previous["num"]), F.lit(False))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.array(e))))).otherwise(F.concat(acc, F.array(F.array(e))))

    def written(run: Column) -> Column:
        omitted = F.transform(F.filter(run, lambda e: e["optional"]), lambda e: e["raw"])
        low, high = F.array_min(F.transform(run, lambda e: e["first"])), F.array_max(F.transform(run, lambda e: e["last"]))
        one = F.array(F.struct(_verses(F.element_at(run, 1)["num"], low, high).alias("citation"), F.lit(False).alias("optional"), omitted.alias("omit")))
        each = F.transform(run, lambda e: F.struct(e["raw"].alias("citation"), e["optional"].alias("optional"), none.alias("omit")))
        return F.when((F.size(run) > 1) & (F.size(omitted) > 0), one).otherwise(each)

    merged = F.flatten(F.transform(F.aggregate(entries, start, collect), written))
    inner = F.transform(F.split(F.regexp_replace(F.trim(tokens), r"^\[|\]$", ""), ","), lambda x: F.trim(x))
    all_optional = F.transform(F.filter(inner, lambda x: x != ""), lambda x: F.struct(x.alias("citation"), F.lit(True).alias("optional"), none.alias("omit")))
    return F.when(whole, all_optional).otherwise(merged)


def _verses(num: Column, first: Column, last: Column) -> Column:
    return F.concat(num.cast("string"), F.lit(":"), first.cast("string"), F.when(first == last, "").otherwise(F.concat(F.lit("-"), last.cast("string"))))


def without_omitted(verses: Column, omit: Column) -> Column:
    """Verse numbers of a psalm but for those in the spans ``N:a-b`` of ``omit``."""
    spans = F.transform(omit, psalm_citation)
    return F.filter(verses, lambda v: ~F.exists(spans, lambda s: v.between(s["first"], s["last"])))


def psalm_citation(c: Column) -> Column:
    """``struct(num, first, last)`` of ``N``, ``N:v`` or ``N:a-b``."""
    num = F.regexp_extract(c, r"^(\d+)", 1).try_cast("int")
    first = F.regexp_extract(c, r"^\d+:(\d+)", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(c, r"^\d+:\d+-(\d+)", 1).try_cast("int"), first)
    return F.struct(num.alias("num"), first.alias("first"), last.alias("last"))


# scripture


def citation(c: Column) -> Column:
    """``struct(book, rest)``: the abbreviation and the verses of the first alternative; null where there are no verses."""
    one = F.trim(F.regexp_extract(F.regexp_replace(c, r"^[Oo]r\s+", ""), r"(?s)^(.*?)(?: or .*)?$", 1))
    shape = r"^((?:[1-4] )?[^0-9:]+)([0-9:].*)$"
    book = F.trim(F.regexp_extract(one, shape, 1))
    return F.when(book != "", F.struct(book.alias("book"), F.trim(F.regexp_extract(one, shape, 2)).alias("rest")))


# fixed values: abbreviations of the books and the names they stand for
BOOKS = {
    "Gen": "Genesis", "Ex": "Exodus", "Lev": "Leviticus", "Num": "Numbers", "Dt": "Deuteronomy", "Jos": "Joshua", "Jg": "Judges", "Ruth": "Ruth",
    "1 Sam": "1 Samuel", "2 Sam": "2 Samuel", "1 Kgs": "1 Kings", "2 Kgs": "2 Kings", "1 Chr": "1 Chronicles", "2 Chr": "2 Chronicles", "Ezra": "Ezra",
    "Neh": "Nehemiah", "Est": "Esther", "Job": "Job", "Ps": "Psalm", "Pr": "Proverbs", "Ec": "Ecclesiastes", "Song": "Song Of Songs", "Is": "Isaiah",
    "Jer": "Jeremiah", "Lam": "Lamentations", "Ezek": "Ezekiel", "Dan": "Daniel", "Hos": "Hosea", "Jl": "Joel", "Am": "Amos", "Ob": "Obadiah", "Jon": "Jonah",
    "Mic": "Micah", "Nah": "Nahum", "Hab": "Habakkuk", "Zeph": "Zephaniah", "Hag": "Haggai", "Zech": "Zechariah", "Mal": "Malachi", "Mt": "Matthew",
    "Mk": "Mark", "Lk": "Luke", "Jn": "John", "Acts": "Acts", "Rom": "Romans", "1 Cor": "1 Corinthians", "2 Cor": "2 Corinthians", "Gal": "Galatians",
    "Eph": "Ephesians", "Phil": "Philippians", "Col": "Colossians", "1 Th": "1 Thessalonians", "2 Th": "2 Thessalonians", "1 Tim": "1 Timothy",
    "2 Tim": "2 Timothy", "Tit": "Titus", "Philem": "Philemon", "Heb": "Hebrews", "Jas": "James", "1 Pet": "1 Peter", "2 Pet": "2 Peter", "1 Jn": "1 John",
    "2 Jn": "2 John", "3 Jn": "3 John", "Jude": "Jude", "Rev": "Revelation", "Tob": "Tobit", "Jdt": "Judith", "Wis": "Wisdom Of Solomon", "Sir": "Sirach",
    "Bar": "Baruch", "1 Macc": "1 Maccabees", "2 Macc": "2 Maccabees", "2 Esd": "2 Esdras",
}
SINGLE_CHAPTER = ("2 John", "3 John", "Jude", "Obadiah", "Philemon")


def resolved_citation(c: Column, books: dict[str, str] | None = None, single: tuple[str, ...] = SINGLE_CHAPTER) -> Column:
    """``struct(abbrev, book, rest, inferred)`` of the first alternative; null where the book is unknown. In a book of one chapter verses
    without a chapter stand in chapter 1 (``inferred``)."""
    names = F.create_map(*[F.lit(x) for pair in (books or BOOKS).items() for x in pair])
    cited = citation(c)
    book = F.try_element_at(names, cited.getField("book"))
    rest = cited.getField("rest")
    inferred = book.isin(*single) & ~rest.contains(":")
    return F.when(book.isNotNull(), F.struct(cited.getField("book").alias("abbrev"), book.alias("book"), F.when(inferred, F.concat(F.lit("1:"), rest)).otherwise(rest).alias("rest"), inferred.alias("inferred")))


def displayed_citation(c: Column, books: dict[str, str] | None = None, single: tuple[str, ...] = SINGLE_CHAPTER) -> Column:
    """Every alternative of a citation with its book's full name, an inferred chapter left out; unknown ones as they are."""

    def full(x: Column) -> Column:
        r = resolved_citation(F.trim(x), books, single)
        rest = F.when(r.getField("inferred"), F.regexp_replace(r.getField("rest"), "^1:", "")).otherwise(r.getField("rest"))
        return F.coalesce(F.when(rest != "", F.concat(r.getField("book"), F.lit(" "), rest)).otherwise(r.getField("book")), F.trim(x))

    return F.array_join(F.transform(F.split(c, " or "), full), " or ")


def verse_ranges(rest: Column) -> Column:
    """``array<struct(start_ch, start_v, end_ch, end_v)>`` of ``1:1-10, 12, 2:3—3:5``.

    A fold over comma pieces that carries the chapter; an em dash spans chapters; half-verse letters are dropped, and
    pieces before any chapter are too.
    """
    entry = "struct<start_ch:int,start_v:int,end_ch:int,end_v:int>"
    start = F.struct(F.lit(None).cast("int").alias("ch"), F.expr(f"cast(array() as array<{entry}>)").alias("out"))

    def number(c: Column, pattern: str) -> Column:
        return F.regexp_extract(c, pattern, 1).try_cast("int")

    def step(acc: Column, raw: Column) -> Column:
        t = F.regexp_replace(F.trim(raw), r"^\(|\)$", "")
        left = F.regexp_extract(t, r"^([^—]*)", 1)
        right = F.regexp_extract(t, r"—\s*(.*)$", 1)
        ch = F.coalesce(number(left, r"^\s*(\d+)\s*:"), acc["ch"])
        span = F.regexp_replace(left, r"^\s*\d+\s*:", "")
        v = number(span, r"^\s*(\d+)")
        same = F.coalesce(number(span, r"-\s*(\d+)"), v)
        end_ch = F.when(right != "", F.coalesce(number(right, r"^(\d+)\s*:"), ch)).otherwise(ch)
        end_v = F.when(right != "", F.coalesce(number(right, r":\s*(\d+)"), number(right, r"^(\d+)"))).otherwise(same)
        item = F.struct(ch.alias("start_ch"), v.alias("start_v"), end_ch.alias("end_ch"), end_v.alias("end_v"))
        ok = ch.isNotNull() & v.isNotNull() & end_v.isNotNull()
        return F.struct(F.when(ok, end_ch).otherwise(ch).alias("ch"), F.when(ok, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(rest, ","), start, step, lambda acc: acc["out"])


# collects


def collect_page(ref: Column) -> Column:
    """The leading page of a collect reference."""
    return _lit_or_null(F.regexp_extract(ref, r"(\d+)", 1))


def secondary_page(ref: Column) -> Column:
    """The second page of a collect reference: ``or N, PAGE``, else ``or`` and three digits or more; brackets aside."""
    bare = F.regexp_replace(ref, r"\([^)]*\)", "")
    return F.coalesce(_lit_or_null(F.regexp_extract(bare, r"\bor\s+\d+,\s+(\d+)", 1)), _lit_or_null(F.regexp_extract(bare, r"\bor\s+(\d{3,})\b", 1)))


def commemoration_pages(ref: Column) -> Column:
    """``array<struct(of, pages)>`` of ``(Com X: 438/9 or …)``; ``438/9`` names pages 438 and 439."""
    blocks = F.regexp_extract_all(ref, F.lit(r"\((?:Com|Mem)[^:)]*:[^)]*\)"), F.lit(0))

    def pages(block: Column) -> Column:
        body = F.regexp_extract(F.regexp_replace(block, r"\bFAS\b.*$", ""), r":(.*)$", 1)
        pairs = F.regexp_extract_all(body, F.lit(r"\d+(?:/\d+)?"), F.lit(0))

        def expand(p: Column) -> Column:
            a, b = F.regexp_extract(p, r"^(\d+)", 1), F.regexp_extract(p, r"/(\d+)$", 1)
            second = F.when(F.length(b) >= F.length(a), b).otherwise(F.concat(F.left(a, F.length(a) - F.length(b)), b))
            return F.when(b == "", F.array(a)).otherwise(F.array(a, second))

        return F.flatten(F.transform(pairs, expand))

    all_ = F.transform(blocks, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\((?:Com|Mem)([^:)]*):", 1)).alias("of"), pages(x).alias("pages")))
    return F.filter(all_, lambda x: F.size(x["pages"]) > 0)


def inline_collect(eucharist: Column) -> Column:
    """The text between ``Collect of the Day:`` and its ``Amen``, closed by ``Amen.``."""
    flat = clean_inline(eucharist)
    body = F.regexp_extract(flat, r"Collect of the Day:\s*(.*?)\s*Amen\.?", 1)
    return F.when(body != "", F.concat(body, F.lit(" Amen.")))


def notes(cell: Column) -> Column:
    """``array<struct(type, text)>`` of a notes cell; a segment without a type is pastoral."""
    segments = F.filter(F.transform(F.split(cell, r"(?i)<br\s*/?>"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.coalesce(_lit_or_null(F.regexp_extract(x, r"^\[([a-z]+)\]", 1)), F.lit("pastoral"))
    return F.transform(segments, lambda x: F.struct(kind(x).alias("type"), F.trim(F.regexp_replace(x, r"^\[[a-z]+\]", "")).alias("text")))


def typed_notes(cell: Column, types: Column) -> Column:
    """``array<struct(type, text)>`` of a notes cell whose types are given: one for all of the cell, or one a part. Another number of types
    than of parts is an error; no types at all leave ``notes``' own."""
    segments = F.filter(F.transform(F.split(cell, r"(?i)<br\s*/?>"), lambda x: F.trim(x)), lambda x: x != "")
    one = F.array(F.struct(F.element_at(types, 1).alias("type"), F.array_join(segments, "\n").alias("text")))
    each = F.zip_with(types, segments, lambda t, s: F.struct(t.alias("type"), s.alias("text")))
    wrong = F.raise_error(F.concat(F.lit("types and notes differ in number: "), F.coalesce(cell, F.lit("null"))))
    return F.when(F.coalesce(F.size(types), F.lit(0)) <= 0, notes(cell)).when(F.size(types) == 1, one).when(F.size(types) == F.size(segments), each).otherwise(wrong)


def antiphon(text: Column) -> Column:
    """An antiphon without the ember day's note that follows it."""
    return F.trim(F.regexp_replace(text, r"(?s)\s*Ember Day:.*$", ""))
