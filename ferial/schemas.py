"""Explicit schemas of the data model; a missing key is null, an empty list stays an empty list."""

from __future__ import annotations

ENTRY = "struct<citation:string,optional:boolean,omit:array<string>>"
CALENDAR_CSV = "date string, name string, eucharist string, morning string, evening string, extra string"
DAYS = (
    "date date, name string, rank string, colour string, eucharist string, commemoration_join string, observances array<string>, "
    "commemorations array<struct<name:string,rank:string,colour:string,coequal:boolean>>, notes array<struct<type:string,text:string>>, collect_inline string"
)
DAY_OFFICES = (
    f"date date, office string, slot string, psalms array<{ENTRY}>, psalm_sets array<array<{ENTRY}>>, lessons array<{ENTRY}>, lessons_pick int, "
    "collect string, label string, rubric string, title string, note string, year_note string, colour string, rank string, optional boolean"
)
BOUNDS = "key string, start date"
SEGMENTS = (
    "form string, section string, section_ord int, seq int, path string, depth int, group_no int, group_label string, kind string, text string, shared_key string"
)
VERSES = "translation string, book string, ch int, v int, text string"
PARAGRAPHS = "book string, ch int, first_v int"
PSALMS = "number int, book int, title string, text string"
COLLECTS = "page string, name string, section string, season string, text string, proper int, date string"
SAINTS = "key string, date string, rank string, bio string, sentence string, sentence_ref string, collect string, psalm string, refrain string, readings array<string>"
CORRECTIONS = "category string, id string, source string, reason string, form string, ord int, old string, new string, count int"
SPANS = "page int, x0 double, y0 double, x1 double, y1 double, size double, flags int, color int, text string"
FINDINGS = "tool string, form string, rule string, tier int, detail string"
