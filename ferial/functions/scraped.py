"""The grammar of scraped day pages: offices on one line, psalms without continuation, and a page's elements as a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferial.functions.grammar import title_meta
from ferial.functions.text import strip
from ferial.sources.readers import html_by_id

_PREFIX = r"(?i)^(?:Psalms?|Ps)\b\.?\s*"
_ENTRY = "struct<citation:string,optional:boolean>"


def psalm_group(c: Column) -> Column:
    """``array<struct(citation, optional)>`` of one choice; brackets around all of it, or around a psalm, make optional."""
    text = strip(c)
    whole = text.rlike(r"^\[[^\]]+\]$")
    body = F.when(whole, F.regexp_replace(text, r"^\[|\]$", "")).otherwise(text)

    def entry(t: Column) -> Column:
        bracketed = t.rlike(r"(?s)^(?:\[.*\]|\(.*\))$")
        inner = F.when(bracketed, strip(F.regexp_replace(t, r"^[\[(]|[\])]$", ""))).otherwise(t)
        return F.struct(F.when(whole, t).otherwise(strip(F.regexp_replace(inner, _PREFIX, ""))).alias("citation"), (whole | bracketed).alias("optional"))

    return F.filter(F.transform(F.transform(F.split(body, r",\s*"), strip), entry), lambda e: e["citation"] != "")


def psalm_choices(c: Column) -> Column:
    """The choices that `` or `` divides, one where there is none."""
    return F.transform(F.filter(F.split(F.regexp_replace(strip(c), _PREFIX, ""), r"\s+or\s+"), lambda x: strip(x) != ""), psalm_group)


def is_bare_psalms(c: Column) -> Column:
    """Psalm numbers without a prefix: digits, brackets, commas and the word or."""
    rest = F.regexp_replace(c, r"(?i)\bor\b", "")
    return rest.rlike(r"\d") & rest.rlike(r"^[\d\[\]()\s,\-]+$")


def office_text(c: Column) -> Column:
    """``struct(psalms, psalm_sets, year_note, lessons, collect)`` of an office on one line; what follows an ``Or`` before a capital is left out.

    ``psalm_sets`` holds the choices of the last psalm field that has several, ``psalms`` all others, in order.
    """
    text = F.regexp_replace(strip(c), r"(?i)^(?:Morning Prayer|Evening Prayer|Evensong)\s*:\s*", "")
    text = F.regexp_replace(text, r"(?s)\s+Or\s+(?=[A-Z]).*$", "")
    year = r"(?i)^\(Year\s+(\d+)\)\s*"
    parts = F.filter(F.transform(F.split(text, ";"), strip), lambda x: x != "")

    def named(x: Column) -> Column:
        rest = strip(F.regexp_replace(x, year, ""))
        rest = F.regexp_replace(rest, r"(?is)^[^;:]+:\s*((?:Psalms?|Ps)\b.+)$", "$1")
        rest = F.regexp_replace(rest, r"(?is)^\([^)]+\)\s+((?:Psalms?|Ps)\b.+)$", "$1")
        collect = F.regexp_extract(rest, r"(?is)^(?:Collect|Coll\.?)\s+(.+)", 1)
        kind = F.when(collect != "", "collect").when(rest.rlike(_PREFIX) | is_bare_psalms(rest), F.when(F.size(psalm_choices(rest)) > 1, "sets").otherwise("psalms")).otherwise("lesson")
        return F.struct(kind.alias("kind"), F.when(collect != "", strip(collect)).otherwise(rest).alias("text"), F.regexp_extract(x, year, 1).alias("year"))

    fields = F.transform(parts, named)
    of = lambda kind: F.transform(F.filter(fields, lambda f: f["kind"] == kind), lambda f: f["text"])
    last = lambda a: F.try_element_at(a, F.lit(-1))
    optional = lambda t: t.rlike(r"(?s)^\(.*\)$")
    lessons = F.transform(F.filter(of("lesson"), lambda t: t != ""), lambda t: F.struct(F.when(optional(t), strip(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t).alias("citation"), optional(t).alias("optional")))
    return F.struct(
        F.flatten(F.transform(of("psalms"), lambda t: F.coalesce(F.try_element_at(psalm_choices(t), F.lit(1)), F.expr(f"cast(array() as array<{_ENTRY}>)")))).alias("psalms"),
        psalm_choices(last(of("sets"))).alias("psalm_sets"),
        last(F.transform(F.filter(fields, lambda f: f["year"] != ""), lambda f: f["year"])).alias("year_note"),
        lessons.alias("lessons"), last(of("collect")).alias("collect"),
    )


def html_days(pages: DataFrame, html: str, title: str = "lectionary_title", morning: str = "lectionary_MP", evening: str = "lectionary_EP", eucharist: str = "lectionary_HE", note: str = "lectionary_subtitle") -> DataFrame:
    """``pages`` with ``name, rank, colour, mp, ep, eucharist, note`` read from five elements; pages without a title are left out."""
    found = html_by_id(pages, html, [title, morning, evening, eucharist, note]).where(F.coalesce(F.col(title), F.lit("")) != "")
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    meta = title_meta(F.col(title))
    return found.select(
        *[c for c in pages.columns if c != html], meta.getField("name").alias("name"), meta.getField("rank").alias("rank"), meta.getField("colour").alias("colour"),
        F.when(blank(F.col(morning)).isNotNull(), office_text(F.col(morning))).alias("mp"), F.when(blank(F.col(evening)).isNotNull(), office_text(F.col(evening))).alias("ep"),
        blank(F.regexp_replace(eucharist, r"(?i)^Holy Eucharist\s*:\s*", "")).alias("eucharist"), blank(F.col(note)).alias("note"),
    )
