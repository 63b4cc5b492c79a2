"""Queries over small stated tables: grammars and rules whose results are given beside them, worked out by hand."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferial.functions import colour, dates, grammar, scraped, text
from ferial.operators import align, audit, calendar, corrections, geometry, segments
from ferial.plans import forms
from ferial.runtime import ensure_checkpoint_dir, small
from ferial.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{v}::DOUBLE" if isinstance(v, float) else str(v)


def _twin(cols: list[str], rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ") t(" + ", ".join(f'"{c}"' for c in cols) + ")"


def values(name: str, build: Callable[[Column], Column], cases: list[tuple], kind: str = "string") -> None:
    """A query ``x, y`` of a column function over texts, with the results it must have."""
    given = [c[0] for c in cases]
    QUERIES[name] = lambda spark, d: small(spark, [(g,) for g in given], f"x {kind}").select("x", build(F.col("x")).alias("y"))
    ORACLE[name] = _twin(["x", "y"], cases)


def rows(name: str, cols: list[str], expected: list[tuple]) -> Callable:
    """A query given as a function of the session, with the rows it must have."""

    def register(f: Callable[[SparkSession], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: f(spark).select(*cols)
        ORACLE[name] = _twin(cols, expected)
        return f

    return register


def _listed(c: Column, item: Callable[[Column], Column], sep: str = "; ") -> Column:
    return F.array_join(F.transform(c, item), sep)


def _entry(e: Column) -> Column:
    return F.concat(e["citation"], F.when(e["optional"], "?").otherwise(""))


# grammars

values("citation_resolved", lambda c: F.concat_ws("|", *[grammar.resolved_citation(c).getField(f) for f in ("abbrev", "book", "rest")], grammar.resolved_citation(c).getField("inferred").cast("string")), [
    ("Mt 5:1-12", "Mt|Matthew|5:1-12|false"), ("Jude 17-25", "Jude|Jude|1:17-25|true"), ("3 Jn 1-15", "3 Jn|3 John|1:1-15|true"), ("Philem 1:4", "Philem|Philemon|1:4|false"), ("Mt 5", "Mt|Matthew|5|false"),
    ("or 1 Sam 2:1a or Ex 3:4", "1 Sam|1 Samuel|2:1a|false"), ("Nowhere 1:2", ""), ("the reading", ""), ("Song 2:8", "Song|Song Of Songs|2:8|false"),
])
values("citation_displayed", grammar.displayed_citation, [
    ("Mt 5:1-12", "Matthew 5:1-12"), ("Jude 17-25", "Jude 17-25"), ("Gen 1:1 or Ex 3:4", "Genesis 1:1 or Exodus 3:4"), ("Nowhere 1:2 or Mk 1", "Nowhere 1:2 or Mark 1"), ("2 Esd 2:42", "2 Esdras 2:42"), ("silence", "silence"),
])
values("collect_second_page", grammar.secondary_page, [
    ("344 or 8, 677 (The King)", "677"), ("378 or 17, 680 (Labour Day)", "680"), ("365 or 413 or FAS 211", "413"), ("430 or FAS 359", None), ("12", None), ("12 (or 345)", None), ("12 or 34", None),
])
values("psalm_runs_merged", lambda c: _listed(grammar.psalm_citations(c), lambda e: F.concat(_entry(e), F.when(F.size(e["omit"]) > 0, F.concat(F.lit(" without "), F.array_join(e["omit"], "+"))).otherwise(""))), [
    ("101, 109:1-4, (5-19), 20-30", "101; 109:1-30 without 109:5-19"), ("92:1-2, 11-14", "92:1-2; 92:11-14"), ("10:1-4, (5-9), 10-12, (13)", "10:1-13 without 10:5-9+10:13"), ("146, 147", "146; 147"),
    ("[59, 60]", "59?; 60?"), ("(95), 96", "95?; 96"), ("12:1-2, 8-9, 13:4", "12:1-2; 12:8-9; 13:4"), ("", ""),
])
values("scraped_psalms", lambda c: _listed(scraped.psalm_choices(c), lambda g: F.concat(F.lit("["), _listed(g, _entry, ", "), F.lit("]")), " "), [
    ("97, 99, [100]", "[97, 99, 100?]"), ("[59, 60] or 118", "[59?, 60?] [118]"), ("Psalm 94, (95)", "[94, 95?]"), ("Ps. 113, 114 or 118", "[113, 114] [118]"), ("Ps 119:1-8", "[119:1-8]"),
])


def _office(c: Column) -> Column:
    o = scraped.office_text(c)
    return F.concat_ws(
        " | ", _listed(o.getField("psalms"), _entry, ","), F.coalesce(F.size(o.getField("psalm_sets")).cast("string"), F.lit("-")), F.coalesce(o.getField("year_note"), F.lit("-")),
        _listed(o.getField("lessons"), _entry, "/"), F.coalesce(o.getField("collect"), F.lit("-")),
    )


values("scraped_office", _office, [
    ("Morning Prayer: (Year 2) Ps 146, 147; Am 1:1-5, 13—2:8; 1 Th 5:1-11; Coll 268", "146,147 | - | 2 | Am 1:1-5, 13—2:8/1 Th 5:1-11 | 268"),
    ("Evening Prayer: Psalm 94, [95]; (1 Samuel 16:1-13a); Luke 10:1-17; Collect 344", "94,95? | - | - | 1 Samuel 16:1-13a?/Luke 10:1-17 | 344"),
    ("Morning Prayer: Saint Stephen: Ps 28, 30; Acts 6:1-7; Coll 417 or FAS 229 Or Feria: Ps 145; Lam 1:1", "28,30 | - | - | Acts 6:1-7 | 417 or FAS 229"),
    ("evensong : [59, 60] or 118; 3 Jn 1-15", " | 2 | - | 3 Jn 1-15 | -"), ("Morning Prayer: (First Evensong) Ps 89:1-29; 8, 84", "89:1-29,8,84 | - | - |  | -"), ("", " | - | - |  | -"),
])
values("joined_commemorations", lambda c: grammar.commemoration_join(c, {"and / or": "or", "or both together": "and"}), [
    ("A - Com (White)\nand / or\nB - Com (White)", "or"), ("A - Com\nOr  both together\nB - Com", "and"), ("A - HD\nand / or\nB - Com", None), ("A - Com\nB - Com", None), ("A", None),
])
values("lesson_repairs", lambda c: _entry(grammar.repair_lesson(c)), [("Mt: 22:23", "Mt 22:23"), ("Gal 4.21", "Gal 4:21"), ("(1 Jn 2:1)", "1 Jn 2:1?"), ("the reading", "the reading")])
values("title_forms", lambda c: F.concat_ws("|", *[F.coalesce(grammar.title_meta(c).getField(f), F.lit("-")) for f in ("name", "rank", "colour")]), [
    ("Saint Mark - HD (Red)", "Saint Mark|holy_day|Red"), ("Friday in Lent", "Friday in Lent|feria|-"), ("All Souls (Com)", "All Souls|commemoration|-"), ("The Visitation (White or Blue)", "The Visitation|holy_day|White or Blue"),
])
values("inline_observances", lambda c: F.array_join(grammar.observance_lines(c), " / "), [
    ("A - Com (White) and B - Com", "A - Com (White) / B - Com"), ("A and B - Com", "A and B - Com"), ("A<br>B<br/> <br>C", "A / B / C"), ("A &amp; B", "A & B"),
])
values("eve_targets", grammar.eve_target, [("Eve of the Quiet Gate - PF", "quiet gate"), ("Eve of Embers", "embers"), ("The Eve", None)])
values("heading_dates", lambda c: F.concat_ws("|", forms.is_date_line(c).cast("string"), dates.month_first(c)), [
    ("12 January", "true|January 12"), ("3 May (or 4 May) — Memorial", "false|May 3"), ("January 12", "true|January 12"), ("12 Januarys", "false|12 Januarys"),
])
values("suppressed_rubrics", lambda c: forms.suppressed(c, [r"^The Lord['’]?s Prayer\.?\s*$"]), [("The Lord’s Prayer.", True), ("The Lord's Prayer is omitted.", False), ("Stand", False)])
values("citation_keys", forms.citation_key, [("Mt 1:2–3", "1:2-3"), ("Matthew 1:2-3", "1:2-3"), ("Jude 3", "3")])

# texts

values("word_repairs", lambda c: text.undouble(text.dehyphenate(c, [("hard", "pressed")])), [
    ("doc-\ntrine", "doctrine"), ("mid-\nVictorian", "mid-Victorian"), ("hard-\npressed", "hard-pressed"), ("the the end", "the end"), ("at at", "at at"), ("Holy holy day", "Holy day"),
])
values("citation_punctuation", text.plain_citation, [("Mt 1.1", "Mt 1:1"), ("Lk 2:51c–60", "Lk 2:51c-60"), ("Acts 6:8–7:2a", "Acts 6:8—7:2a")])
values("midpoints", text.bind_midpoint, [("praise *\nhim", "praise *\nhim"), ("praise*", "praise *"), ("*", "*")])
values("placeholders", text.mark_placeholder, [("Bless N, and N.", "Bless (N), and (N)."), ("No N", "No N"), ("NN ,", "NN ,")])
values("straight_quotes", text.straighten_quotes, [("“ Come”", '"Come"'), ("it’s", "it's"), ('say " yes"', 'say "yes"')])
values("named_bodies", lambda c: F.concat_ws("|", F.coalesce(text.split_name_body(c).getField("name"), F.lit("-")), text.split_name_body(c).getField("body")), [("Ann: Lord, hear.", "Ann|Lord, hear."), ("Lord, hear.", "-|Lord, hear."), ("a\nb: c", "-|a\nb: c")])
values("amens", lambda c: F.array_join(text.split_amen(c), "|"), [("Go. Amen.", "Go.|Amen."), ("Amen.", "Amen."), ("a\nAmen.", "a|Amen.")])
_LINE = hashlib.sha256("caf\u00e9 au lait".encode()).hexdigest()[:10]
values("canonical_lines", text.line_id, [("caf\u00e9  au lait", _LINE), ("cafe\u0301 au\u00a0lait ", _LINE)])
values("roman_labels", segments.roman, [(4, "IV"), (1999, "MCMXCIX"), (88, "LXXXVIII"), (1, "I")], "int")
values("hex_lists", lambda c: F.array_join(colour.colour_hexes(c, {"White": "#f0", "Red": "#f1", "Green": "#f2", "Violet": "#f3", "Blue": "#f4", "Gold": "#f5"}), " "), [
    ("White or Gold", "#f0 #f5"), ("Red or other appropriate colour", "#f1 #f0 #f2 #f3 #f4"), ("Puce or Red or Red", "#f1"), ("Puce", ""),
])


@rows("colour_mixes", ["a", "b", "mixed"], [("#FFFFFF", "#000000", "#636363"), ("#FF0000", "#FF0000", "#FF0000"), ("#000000", "#000000", "#000000")])
def _mixes(spark):
    given = small(spark, [("#FFFFFF", "#000000"), ("#FF0000", "#FF0000"), ("#000000", "#000000")], "a string, b string")
    return given.select("a", "b", colour.mix_oklab(F.col("a"), F.col("b"), F.lit(0.5)).alias("mixed"))


# rules


@rows("html_day_entries", ["day", "name", "rank", "colour", "psalms", "eucharist", "note"], [("d1", "Saint Mark", "holy_day", "Red", "28", "Mk 1:1", "Kept & shared"), ("d2", "Friday in Lent", "feria", None, None, None, None)])
def _html_days(spark):
    pages = small(spark, [
        ("d1", '<div id="lectionary_title"><b>Saint Mark</b> - HD (Red)</div><p id="lectionary_MP">Morning Prayer: Ps 28<br>; Acts 1:1</p><p id="lectionary_HE">Holy Eucharist: Mk 1:1</p><i id="lectionary_subtitle">Kept &amp; shared</i>'),
        ("d2", '<h1 id="lectionary_title">Friday  in Lent</h1><p id="lectionary_MP"> </p>'), ("d3", "<p>nothing</p>"), ("d4", None),
    ], "day string, html string")
    out = scraped.html_days(pages, "html")
    return out.withColumn("psalms", _listed(F.col("mp.psalms"), _entry, ","))


@rows("errata_alignment", ["id", "kind", "ours", "theirs"], [
    (1, "MISSING-BREAK", "the light of Christ", "walk in the day go"), (1, "WORDING", "peace", "hope"), (1, "WORDING", "", "always"), (2, "UNALIGNED", "", "quite another text"), (3, "EXTRA-BREAK", "one two", "three four five"),
])
def _errata(spark):
    given = small(spark, [
        (1, ["the light of Christ walk in the day", "go in peace and serve the Lord now"], "the light of Christ\nwalk in the day go in hope and serve the Lord always now and here"), (2, ["something else"], "Quite another text".lower()),
        (3, ["one two\nthree four", "five"], "one two three four\nfive"), (4, ["same words here"], "Same * words, here!"), (5, None, None), (6, ["x"], ""),
    ], "id int, ours array<string>, theirs string")
    found = align.align(given, "id", "ours", "theirs")
    open_, _ = align.undeclared(found, small(spark, [(1, "now and here")], "id int, reads string"), ["id"])
    return open_


_TAGS = [("2026-02-20", "fast_day"), ("2026-02-23", "fast_day"), ("2026-02-22", "fast_day"), ("2026-06-02", "fast_day"), ("2026-12-27", "octave"), ("2027-01-02", "octave"), ("2026-05-05", "other")]


@rows("temporal_windows", ["check", "day", "tag"], [("fast", "2026-02-22", "fast_day"), ("fast", "2026-06-02", "fast_day"), ("window", "2027-01-02", "octave")])
def _windows(spark):
    tags = small(spark, _TAGS, "d string, tag string").select(F.to_date("d").alias("day"), "tag")
    bounds = small(spark, [("ash_wednesday", "2026-02-18"), ("easter", "2026-04-05")], "key string, d string").select("key", F.to_date("d").alias("start"))
    windows = small(spark, [("octave", "2026-12-26", "2027-01-01")], "tag string, s string, e string").select("tag", F.to_date("s").alias("start"), F.to_date("e").alias("end"))
    out = calendar.stray_fast_days(tags, "day", "tag", bounds).withColumn("check", F.lit("fast"))
    return out.unionByName(calendar.outside_windows(tags, "day", "tag", windows).withColumn("check", F.lit("window"))).withColumn("day", F.col("day").cast("string"))


@rows("civil_markers", ["day", "marker"], [("d1", "labour day"), ("d3", "new year")])
def _civil(spark):
    return calendar.untagged_markers(small(spark, [("d1", "Labour Day", None), ("d2", "Labour Day", "t"), ("d3", "the New Year's Day", None), ("d4", "a day", None)], "day string, name string, tag string"), "name", "tag", ["labour day", "new year"])


@rows("line_buckets", ["bucket", "lines"], [("separator", 1), ("commemoration", 2), ("feria", 1), ("other", 1)])
def _buckets(spark):
    given = small(spark, [("and / or",), ("Ann, abbess",), ("Bede - Com",), ("Ember Day",), ("Unknown",), (None,)], "line string")
    low = F.lower("line")
    tests = [("separator", low.rlike("^(?:and / or|or both together)$")), ("commemoration", low.rlike(r" - (?:com|mem|hd|pf)\b") | low.contains(",") | low.rlike(r"\d")), ("feria", low.contains("ember day"))]
    return audit.bucketed_lines(given, "line", tests, "other")


@rows("count_parity", ["form", "left", "right"], [("b", 4, 1), ("c", 0, 3)])
def _parity(spark):
    many = lambda pairs: small(spark, [(k,) for k, n in pairs for _ in range(n)], "form string")
    return audit.parity(many([("a", 3), ("b", 4)]), many([("a", 1), ("b", 1), ("c", 3)]), ["form"], F.lit(2))


@rows("chapter_bounds", ["book", "ch", "first_v", "last_v"], [("B", 1, 1, 3), ("B", 2, 2, 2)])
def _chapters(spark):
    return audit.chapter_ends(small(spark, [("B", 1, 3), ("B", 1, 1), ("B", 2, 2)], "book string, ch int, v int"))


@rows("release_before", ["name"], [("r-0002",)])
def _release(spark):
    return audit.next_older(small(spark, [("r-0001",), ("r-0003",), ("r-0002",), ("r-0004",)], "name string"), "name", "r-0003")


@rows("season_sentences", ["date", "office", "text"], [("d1", "ep", "E"), ("d1", "mp", "L"), ("d2", "mp", "O")])
def _sentences(spark):
    s = small(spark, [("Lent", "morning", 1, "L"), (None, "morning", 1, "O"), (None, "evening", 1, "E")], "grp string, time string, ord int, text string")
    return forms.penitential(s, small(spark, [("d1", "mp", "Lent"), ("d1", "ep", "Lent"), ("d2", "mp", "OrdinaryTime")], "date string, office string, form_season string"))


@rows("midday_rows", ["block", "seq", "kind", "text"], [("reading", 0, "label", "Gal 5"), ("reading", 1, "leader", "text")])
def _midday(spark):
    m = small(spark, [("opening", None, 0, "rubric", "Except in Lent, add"), ("opening", None, 1, "response", "Alleluia!"), ("reading", 1, 2, "leader", "text"), ("reading", 1, 3, "rubric", "Gal 5")], "block string, group_no int, seq int, kind string, text string")
    return forms.midday(m, F.lit("Lent"))


@rows("alternative_groups", ["text", "group_no", "label"], [("a", 1, "I"), ("b", 2, "II"), ("c", 3, "Short form")])
def _alternatives(spark):
    s = small(spark, [("f", i, k, t) for i, (k, t) in enumerate([("leader", "a"), ("rubric", "Or"), ("leader", "b"), ("rubric", "Or Short form"), ("leader", "c")])], "form string, seq int, kind string, text string")
    return segments.group_alternatives(s, ["form"], ["seq"])


@rows("bodies_in_common", ["k", "kept", "body"], [(1, "a / b", "c, d"), (2, "a / b", None)])
def _bodies(spark):
    g = forms.split_common_body(small(spark, [(1, [["a"], ["b", "c", "d"]]), (2, [["a"], ["b"]])], "k int, groups array<array<string>>"), "groups")
    return g.select("k", _listed(F.col("groups"), lambda x: F.array_join(x, ", "), " / ").alias("kept"), F.array_join("body", ", ").alias("body"))


@rows("grouped_lines", ["text", "grp", "item"], [("* a", "Lent", 1), ("* c", "Lent", 2), ("* d", "Easter", 1), ("b", "Lent", 1)])
def _grouped(spark):
    s = small(spark, [("u", i, t) for i, t in enumerate(["Lent", "* a", "b", "* c", "Easter", "* d"])], "u string, seq int, text string")
    return forms.grouped_items(s, ["u"], ["seq"], F.col("text").isin("Lent", "Easter"), F.col("text").startswith("*"))


@rows("correction_provenance", ["id", "problem"], [("1", "no reason"), ("1", "repeated id"), ("1", "repeated id"), ("1", "unknown source"), (None, "no id")])
def _provenance(spark):
    return corrections.provenance(small(spark, [("1", "print", "r"), ("1", "web", " "), (None, "print", "r")], "id string, source string, reason string"), ["print"])


@rows("corrections_of_shared_blocks", ["id", "form"], [("c1", "f"), ("c1", "g")])
def _shared_users(spark):
    refs = small(spark, [("f", "k"), ("g", "k"), ("g", "k"), ("h", "j")], "form string, shared_key string")
    return corrections.shared_users(small(spark, [("c1", "k"), ("c2", "none")], "id string, key string"), refs)


@rows("unmatched_corrections", ["id"], [("2",)])
def _unmatched(spark):
    c = small(spark, [("1", "f", "s"), ("2", "f", "x")], "id string, form string, section string")
    return corrections.unmatched(small(spark, [("f", "s"), ("g", "x")], "form string, section string"), c, ["form", "section"])


@rows("reflowed_lines", ["u", "text", "undecided"], [("p", "wrap short\nend", 0), ("v", "forced chosen\nunsure\npara\n\nlast", 1)])
def _reflowed(spark):
    t = small(spark, [("v", 0, "forced", 0.0, 1.0, -4.0), ("v", 1, "chosen", 0.0, 1.0, 4.0), ("v", 2, "unsure", 0.0, 1.0, 1.0), ("v", 3, "para", 16.0, 1.0, -9.0), ("v", 4, "last", 0.0, 0.0, 0.0), ("p", 0, "wrap", 0.0, 1.0, 59.0), ("p", 1, "short", 0.0, 1.0, 60.0), ("p", 2, "end", 0.0, 0.0, 0.0)], "u string, seq int, text string, lead double, gap double, slack double")
    return geometry.reflow(t, ["u"], ["seq"], F.col("u") == "p")


@rows("span_kinds", ["size", "kind"], [(8.0, "footer"), (11.0, "leader"), (11.5, "response"), (12.0, "rubric"), (14.0, "heading")])
def _spans(spark):
    k = small(spark, [(8.0, 0, 0), (12.0, 0, 0xC00000), (14.0, 0, 0), (11.5, 16, 0), (11.0, 0, 0)], "size double, f int, c int")
    return k.select("size", geometry.span_kind(F.col("size"), F.col("f"), F.col("c")).alias("kind"))


@rows("chapter_verses", ["book", "ch", "v", "text"], [("Bk", 1, 1, "In the dusk"), ("Bk", 1, 2, "and dawn"), ("Bk", 2, 1, "a lamp")])
def _chapter_verses(spark):
    body = '{"chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "In the <S>12</S>dusk"}, {"verse": 2, "text": " and  dawn "}]}, {"chapter": 2, "verses": [{"verse": 1, "text": "a <i>lamp</i>"}]}]}'
    docs = small(spark, [("Bk", body.replace("<S>12</S>", "<S n=12>")), ("None", None)], "book string, body string")
    return readers.chapter_arrays(docs, "body", "book")


@rows("markdown_blocks", ["doc", "block", "heading", "body"], [("d", 1, "One", "a\nb"), ("d", 2, "Two", "c")])
def _markdown(spark):
    lines = ["# One", "x", "```", "a", "b", "```", "## Two", "```", "c", "```", "rest"]
    return readers.fenced_blocks(small(spark, [("d", i, x) for i, x in enumerate(lines)], "doc string, pos int, line string"), "doc", "pos", "line")


@rows("markdown_cells", ["pos", "first", "second"], [(0, "name", "page"), (2, "a", "12")])
def _cells(spark):
    out = readers.table_rows(small(spark, [(0, "| name | page |"), (1, "|---|:--|"), (2, "|a| 12 |"), (3, "no row")], "pos int, line string"), "line")
    return out.select("pos", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


@rows("html_elements", ["k", "a", "b"], [(1, "x y z", None), (2, "", "q"), (3, None, None)])
def _elements(spark):
    given = small(spark, [(1, '<div id="a">x <b>y</b><br>z</div>'), (2, '<p id="a"></p><p id="b">q</p><p id="b">no</p>'), (3, None)], "k int, html string")
    return readers.html_by_id(given, "html", ["a", "b"]).select("k", "a", "b")


values("antiphons", grammar.antiphon, [("O Key, come.  Ember Day: fast.", "O Key, come."), ("O Key", "O Key")])


@rows("typed_note_cells", ["k", "notes"], [(1, "a:x / b:y"), (2, "s:x y"), (3, "pastoral:x / rubric:y"), (4, "")])
def _typed(spark):
    given = small(spark, [(1, "x<br>y", ["a", "b"]), (2, "x<br> <br/>y", ["s"]), (3, "x<br>[rubric] y", None), (4, "", [])], "k int, cell string, types array<string>")
    return given.select("k", F.replace(_listed(grammar.typed_notes(F.col("cell"), F.col("types")), lambda n: F.concat(n["type"], F.lit(":"), n["text"]), " / "), F.lit("\n"), F.lit(" ")).alias("notes"))


@rows("first_replacements", ["k", "t", "stamps", "outcome"], [("a", "1-y-x", "s0,c1", "applied"), ("b", "none", "", "miss"), ("c", "x", "", "untouched"), ("d", "y", "", "applied")])
def _first(spark):
    given = small(spark, [("a", "1-x-x", ["s0"]), ("b", "none", []), ("c", "x", []), ("d", "x", None)], "k string, t string, stamps array<string>")
    c = small(spark, [("a", "c1", "x", "y", "print"), ("b", "c2", "x", "y", "print"), ("d", "c3", "x", "y", " ")], "k string, id string, old string, new string, reason string")
    return corrections.replace_first(given, c, ["k"], "t", "stamps").withColumn("stamps", F.coalesce(F.array_join("stamps", ","), F.lit("")))


@rows("list_replacements", ["k", "items", "missed"], [("a", "p,B,c,D", "9"), ("b", "x", "0"), ("c", "z", "")])
def _lists(spark):
    given = small(spark, [("a", ["p", "b", "c", "d"]), ("b", ["x"]), ("c", ["z"])], "k string, items array<string>")
    c = small(spark, [("a", 1, "b", "B"), ("a", 3, "d", "D"), ("a", 9, "q", "Q"), ("b", 0, "y", "Y")], "k string, idx int, old string, new string")
    return corrections.replace_at(given, c, ["k"], "items").select("k", F.array_join("items", ",").alias("items"), F.array_join("misses", ",").alias("missed"))


@rows("stale_corrections", ["id", "outcome"], [("1", "ok"), ("2", "blank"), ("3", "stale"), ("4", "no target")])
def _stale(spark):
    t = small(spark, [("f", "a\u00a0lamp burns")], "form string, text string")
    return corrections.stale_checks(small(spark, [("1", "f", "burns"), ("2", "f", "a lamp"), ("3", "f", "dusk"), ("4", "g", "x")], "id string, form string, old string"), t, ["form"], "text")


@rows("refused_corrections", ["id", "problem"], [("1", "whole field of every form"), ("3", "correct _shared.k"), ("4", "unknown decision"), ("5", "no decision")])
def _refused(spark):
    c = small(spark, [("1", "*", "s", None), ("2", "*", "s", "x"), ("3", "f", "s", "x")], "id string, form string, section string, old string")
    d = small(spark, [("4", "print", 9), ("5", "review", None), ("6", "print", None), ("7", "review", 1)], "id string, source string, decision int")
    return corrections.refusals(c, small(spark, [("f", "s", "k"), ("f", "t", None)], "form string, section string, shared_key string")).unionByName(corrections.uncited(d, small(spark, [(1,)], "number int"), "review"))


@rows("baseline_members", ["k", "outcome"], [("b", "new"), ("c", "stale")])
def _members(spark):
    return audit.unclaimed(small(spark, [("a",), ("a",), ("b",)], "k string"), small(spark, [("a",), ("c",)], "k string"), ["k"])


@rows("ranges_without_verses", ["id"], [("gone",), ("nobook",), ("reversed",)])
def _ranges(spark):
    v = small(spark, [("B", 1, n) for n in (1, 2, 3)], "book string, ch int, v int")
    r = [("fine", "B", 1, 2, 1, 9), ("reversed", "B", 1, 3, 1, 1), ("gone", "B", 4, 1, 5, 2), ("nobook", "C", 1, 1, 1, 2)]
    return audit.empty_ranges(small(spark, r, "id string, book string, start_ch int, start_v int, end_ch int, end_v int"), v, "id")


@rows("eves_without_feast", ["day"], [("2030-01-03",), ("2030-01-05",)])
def _eves(spark):
    d = [("2030-01-01", True, False), ("2030-01-02", False, True), ("2030-01-03", True, False), ("2030-01-04", False, None), ("2030-01-05", True, True)]
    return calendar.lonely_eves(small(spark, d, "d string, eve boolean, kept boolean").withColumn("day", F.to_date("d")), "day", "eve", "kept").withColumn("day", F.col("day").cast("string"))


@rows("bounds_of_names", ["key", "start"], [("advent_i", "2030-12-01"), ("advent_ii", "2031-11-30"), ("christmas", "2030-12-25"), ("christmas_ii", "2031-12-25"), ("easter", "2031-04-13")])
def _bounds(spark):
    d = [("2030-12-01", "First Sunday of Advent"), ("2030-12-25", "Christmas Day"), ("2031-04-06", "Easter approaches"), ("2031-04-13", "Easter"), ("2031-11-30", "First Sunday of Advent"), ("2031-12-25", "Christmas Day of Easter"), ("2032-12-25", "Christmas Day"), ("2032-01-01", None)]
    p = small(spark, [("advent", "first sunday of advent"), ("christmas", "christmas day"), ("easter", "Easter")], "key string, phrase string")
    out = calendar.detected_bounds(small(spark, d, "d string, name string").withColumn("day", F.to_date("d")), "day", "name", p)
    return out.withColumn("start", F.col("start").cast("string"))


@rows("form_headers", ["form", "title", "subtitle"], [("f", "Dusk", "one two"), ("g", "Dawn", None)])
def _headers(spark):
    s = [("f", 0, "leader", "before"), ("f", 1, "heading", "Dusk"), ("f", 2, "leader", "one"), ("f", 3, "rubric", "r"), ("f", 4, "leader", "two"), ("f", 5, "leader", "three"), ("f", 6, "heading", "Next"), ("g", 0, "heading", "Dawn"), ("g", 1, "heading", "X"), ("g", 2, "leader", "late"), ("h", 0, "leader", "none")]
    return segments.header(small(spark, s, "form string, seq int, kind string, text string"), ["form"], ["seq"])


# writers


@rows("files_by_number", ["number", "n"], [(1, 2), (2, 1)])
def _files(spark):
    path = f"{ensure_checkpoint_dir(spark)}/each-{uuid.uuid4().hex}"
    sinks.write_each(small(spark, [(1, "a"), (1, "b"), (2, "c")], "number int, text string"), path, "number")
    return spark.read.json(path).groupBy(F.col("number").cast("int").alias("number")).agg(F.count("*").cast("int").alias("n"))


@rows("months_written", ["month", "n", "back"], [("2030-01", 2, 2), ("2030-02", 1, 1)])
def _months(spark):
    path = f"{ensure_checkpoint_dir(spark)}/months-{uuid.uuid4().hex}"
    days = small(spark, [("2030-01-05", "x"), ("2030-01-09", "y"), ("2030-02-01", "z")], "d string, v string").select(F.to_date("d").alias("date"), "v")
    sinks.write_months(days, path)
    sinks.write_months(days.where("v = 'z'"), path)  # only its month is replaced
    back = spark.read.json(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").cast("int").alias("back"))
    return days.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").cast("int").alias("n")).join(back, "month")


@rows("mirrored_rows", ["k"], [(1,), (2,)])
def _mirrored(spark):
    path = f"{ensure_checkpoint_dir(spark)}/mirror-{uuid.uuid4().hex}"
    sinks.mirror(small(spark, [(9,)], "k int"), path)
    sinks.mirror(small(spark, [(1,), (2,)], "k int"), path)
    return spark.read.parquet(path)


@rows("report_lines", ["line"], [('{"form":"f","rule":"r"}',), ('{"form":"g","rule":"s"}',)])
def _report(spark):
    return sinks.report(small(spark, [("s", "g"), ("r", "f")], "rule string, form string"))


@rows("malformed_documents", ["file"], [("b.json",), ("c.json",)])
def _malformed(spark):
    path = f"{ensure_checkpoint_dir(spark)}/docs-{uuid.uuid4().hex}"
    for name, body in (("a", '{"x": 1}'), ("b", "[1"), ("c", "")):
        small(spark, [(body or " ",)], "value string").coalesce(1).write.text(f"{path}/{name}.json")
    found = readers.malformed(spark, f"{path}/*/part-*")
    return found.select(F.regexp_extract("file", r"([abc]\.json)", 1).alias("file"))


values("quality_faults", lambda c: F.array_join(text.quality_findings(c, ("OrdinaryTime",), ("ever",)), ","), [
    ("mercyGod is", "missing_space"), ("McDonald and OrdinaryTime", ""), ("Mt 1:2 aB", ""), ("MINISTER", ""), ("the the end", "duplicate_word"), ("at at", ""), ("a" * 30, "long_token"),
    ("half-\ndone", "hanging_hyphen"), ("ever-\nliving", ""), ("xY\nno no Nobody nobody", "missing_space,duplicate_word"),
])
values("page_sections", lambda c: forms.section_of_page(c, [(395, "Sundays"), (397, "Special")], "Occasional"), [(1, "Sundays"), (395, "Sundays"), (396, "Special"), (400, "Occasional")], "int")
values("dates_in_names", forms.date_in_name, [("Saint Mark, 25 April", "25 April"), ("Sunday between 3 and 9 July", None), ("Easter", None)])
values("dates_above_markers", lambda c: forms.date_above(c, "Sentence"), [("x\n1 May Ann\n\nSentence \ntext 2 May", "1 May"), ("1 May\nname\nSentence", None), ("1 May", None)])


@rows("header_markers", ["k", "markers"], [(1, "Day / Eve of X / Fast / Becket"), (2, "Fast"), (3, "")])
def _markers(spark):
    given = small(spark, [
        (1, "Day", "Eve of Y", ["eve_of:X", "eve_of:Y", "fast_day", "other"], [("Becket", False), ("Peer", True)], True), (2, "Day", "Day", ["fast_day"], None, False), (3, "Day", "Day", None, [("Peer", True)], True),
    ], "k int, day string, active string, obs array<string>, com array<struct<name:string,coequal:boolean>>, eve boolean")
    marks = forms.day_markers(F.col("day"), F.col("active"), F.col("obs"), F.col("com"), F.col("eve"), {"fast_day": "Fast"})
    return given.select("k", F.array_join(marks, " / ").alias("markers"))


_GROUPS = "k int, groups array<struct<label:string,segments:array<struct<type:string,text:string>>>>"


def _group(label, *texts):
    return {"label": label, "segments": [{"type": t, "text": x} for t, x in texts]}


def _blocks_of(spark):
    glory = [_group(x, ("leader", f"Glory {x}"), ("response", f"as {x}\nAlleluia.")) for x in ("b", "a", "c")]
    bless = [_group("I", ("leader", "Blessed be"), ("response", "x"))] * 3
    return small(spark, [(1, glory), (2, bless), (3, [_group("Apostles’ Creed", ("leader", "y")), _group("Other")]), (4, glory[:2]), (5, None)], _GROUPS)


@rows("block_kinds", ["k", "doxology", "blessings", "affirmation"], [(1, True, False, False), (2, False, True, False), (3, False, False, True), (4, False, False, False), (5, False, False, False)])
def _kinds(spark):
    g = F.col("groups")
    no = F.lit(False)
    return _blocks_of(spark).select("k", F.coalesce(forms.is_doxology(g), no).alias("doxology"), F.coalesce(forms.is_blessings(g), no).alias("blessings"), F.coalesce(forms.is_affirmation(g), no).alias("affirmation"))


@rows("blocks_in_order", ["k", "first_lines", "cut", "last"], [(1, "I Glory a/II Glory b/III Glory c", True, "as c"), (2, "I Blessed be/I Blessed be/I Blessed be", False, "x"), (4, "b Glory b/a Glory a", True, "as a")])
def _ordered(spark):
    s = forms.split_suffix(F.col("groups"))
    out = _blocks_of(spark).where("k IN (1, 2, 4)").select("k", s.getField("cut").alias("cut"), forms.in_fixed_order(s.getField("groups"), ["Glory a", "Glory b", "Glory c"]).alias("g"))
    lines = _listed(F.col("g"), lambda x: F.concat_ws(" ", x["label"], F.element_at(x["segments"], 1)["text"]), "/")
    return out.select("k", lines.alias("first_lines"), "cut", F.element_at(F.element_at("g", -1)["segments"], -1)["text"].alias("last"))


@rows("collects_of_commemorations", ["day", "ord", "title", "text"], [("d1", 0, "Ann: Four", "t4"), ("d1", 1, "Ann: Five", "t5"), ("d2", 0, "Four", "t4")])
def _commemorated(spark):
    days = small(spark, [("d1", "12 (Com Ann: 438/9)"), ("d2", "3 (Com: 438 or 777)"), ("d3", "5"), ("d4", None)], "day string, ref string")
    return forms.commemoration_collects(days, "ref", small(spark, [("438", "Four", "t4"), ("439", "Five", "t5")], "page string, name string, text string"))


@rows("lonely_cues", ["form", "text"], [("g", "Say:")])
def _cues(spark):
    seg = [(f, "canticle", i, k, t, s) for f, own in (("f", "At the end:"), ("g", "Say:"), ("h", "At the end:")) for i, (k, t, s) in enumerate([("rubric", own, None), ("shared", None, "doxology"), ("rubric", f"only {f}", None), ("shared", None, "other")])]
    s = small(spark, seg, "form string, section string, seq int, kind string, text string, shared_key string")
    return audit.lonely_cues(s, "form", ["section"], ["seq"], "doxology")


@rows("blank_widths", ["k", "space"], [("none", 2.6), ("some", 2.5)])
def _advance(spark):
    gaps = small(spark, [(0.0,), (2.0,), (3.0,), (8.0,), (40.0,)], "gap double")
    return geometry.space_advance(gaps, "gap").select(F.lit("some").alias("k"), "space").unionByName(geometry.space_advance(gaps.where("gap > 8"), "gap").select(F.lit("none").alias("k"), "space"))


@rows("manifest_rows", ["name", "sha256", "bytes"], [("a", "h", 1), ("gone", None, None), ("version:tool", "1.2", None), ("written", "2030-01-01T00:00:00Z", None)])
def _manifest(spark):
    return sinks.manifest(small(spark, [("a", "h", 1)], "name string, sha256 string, bytes bigint"), ["a", "gone"], {"tool": "1.2"}, "2030-01-01T00:00:00Z")
