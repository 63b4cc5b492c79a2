import math

import pytest
from pyspark.sql import functions as F

from ferial.functions import colour, dates, grammar, text


def one(spark, value, build):
    row = spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()
    return row.y


@pytest.mark.parametrize(
    "build, given, want",
    [
        (text.clean, "<b>A</b> &amp; B<br />C&nbsp;", "A & B\nC"),
        (text.clean_inline, " A<br>B  <i>c</i>&ndash;d ", "A B c–d"),
        (text.first_line, "\n  \n x y\nz", "x y"),
        (text.first_line, " \n ", " \n "),
        (text.first_line, "year 1950", "year 1950"),
        (text.escape_html, '<a href="x">&</a>', "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"),
        (text.bind_midpoint, "praise   *\nhim", "praise\u00a0*\nhim"),
        (text.mark_placeholder, "for N, and None. N.", "for (N), and None. (N)."),
        (text.straighten_quotes, "“a” ‘b’", "\"a\" 'b'"),
        (text.title_rank, "holy_day", "Holy Day"),
        (text.read_more_cut, "ab " * 40, ("ab " * 40)[:80].rstrip()),
        (text.read_more_cut, "short", "short"),
        (text.read_more_cut, "x" * 120, "x" * 80),
        (text.split_amen, "Let us. Amen.", ["Let us.", "Amen."]),
        (text.split_amen, "Amen.", ["Amen."]),
        (text.missing_space, "wordAnother", True),
        (text.missing_space, "McDonald", False),
        (text.duplicate_word, "the the end", True),
        (text.duplicate_word, "the then", False),
        (text.hanging_hyphen, "wa- ter", True),
        (text.wrapped_lines, "one two\nthree,\nfour", ["one two"]),
        (text.nfc, "e\u0301", "\u00e9"),
        (text.unescape_all, "&eacute;&#8212;", "é—"),
        (lambda c: text.occurrences(c, F.lit("aa")), "aaaaa", 2),
        (lambda c: text.occurrences(c, F.lit("")), "abc", 0),
        (lambda c: text.split_name_body(c).getField("name"), "Anna: a life", "Anna"),
        (lambda c: text.split_name_body(c).getField("body"), "no name here", "no name here"),
        (lambda c: text.percent(F.lit(1), F.lit(3)), "", "33.3%"),
        (lambda c: text.similarity(c, F.lit("abcd")), "abce", 0.75),
        (dates.month_first, "12 January (or 13 January)", "January 12"),
        (lambda c: dates.long_date(F.to_date(c)), "2031-06-08", "Sunday, 8 June 2031"),
        (lambda c: dates.weekday(F.to_date(c)), "2031-06-08", 0),
        (lambda c: dates.week_index(F.to_date(c), F.lit("2031-06-10").cast("date")), "2031-06-08", -1),
        (lambda c: dates.office_of(c.cast("timestamp")), "2031-06-08 15:00:00", "ep"),
        (lambda c: colour.composite(c, F.lit("#000000"), F.lit(0.5)), "#ffffff", "#808080"),
        (colour.colour_names, "White or Red or White", ["White", "Red"]),
    ],
)
def test_text(spark, build, given, want):
    got = one(spark, given, build)
    assert math.isclose(got, want) if isinstance(want, float) else got == want


def test_contrast(spark):
    assert round(one(spark, "#ffffff", lambda c: colour.contrast(c, F.lit("#000000"))), 2) == 21


def test_nulls_stay_null(spark):
    for build in (text.clean, text.clean_inline, text.first_line, text.squash, text.read_more_cut, grammar.collect_page, grammar.inline_collect, grammar.citation, grammar.eve_target, text.nfc):
        assert one(spark, None, build) is None


@pytest.mark.parametrize(
    "line, want",
    [
        ("Feast of Oil - PF (White) [note]", ("Feast of Oil", "principal_feast", "White")),
        ("Third Sunday of Rain", ("Third Sunday of Rain", "holy_day", None)),
        ("Monday (Green)", ("Monday", "feria", "Green")),
        ("A - Mem", ("A", "memorial", None)),
    ],
)
def test_name_meta(spark, line, want):
    assert tuple(one(spark, line, grammar.name_meta)) == want


def test_title_meta(spark):
    for raw, want in (("A - HD (Red)", ("A", "holy_day", "Red")), ("B (White) - PF", ("B", "principal_feast", "White")), ("C (Com)", ("C", "commemoration", None)), ("Friday after D", ("Friday after D", "feria", None)), ("E (Blue)", ("E", "holy_day", "Blue"))):
        assert tuple(one(spark, raw, grammar.title_meta)) == want, raw


def test_observances_and_commemorations(spark):
    raw = "Day (Green)<br>X - Com (White) and Y - Com<br>Z and W - Mem<br>V - HD (Green)"
    assert one(spark, raw, grammar.observance_lines) == ["Day (Green)", "X - Com (White)", "Y - Com", "Z and W - Mem", "V - HD (Green)"]
    got = [tuple(c) for c in one(spark, "D - HD (Red)<br>E - HD (Red)<br>F<br>G - Com", grammar.commemorations)]
    assert got == [("E", "holy_day", "Red", True), ("G", "commemoration", None, False)]
    assert one(spark, "Eve of the Rain - PF", grammar.eve_target) == "rain"


def test_office_fields(spark):
    raw = "Feast of Oil: Ps 1, 2; Mt: 22:23; (Gal 4.21); Ps 9; Coll 12<br>Or<br>two of the following three readings: Year note: Ps 3"
    branches = one(spark, raw, grammar.office_branches)
    assert len(branches) == 2
    f = one(spark, branches[0], grammar.office_fields)
    assert (f.label, f.rubric, f.psalms, f.collect, f.lessons_pick) == ("Feast of Oil", None, "Ps 1, 2", "12", None)
    assert [tuple(x) for x in f.lessons] == [("Mt 22:23", False), ("Gal 4:21", True), ("Ps 9", False)]
    f = one(spark, branches[1], grammar.office_fields)
    assert (f.lessons_pick, f.rubric, f.psalms) == (2, "Year note", "Ps 3")
    f = one(spark, "(Year 1) Ps 5; Coll above", grammar.office_fields)
    assert (f.year_note, f.psalms, f.collect, f.lessons) == ("1", "Ps 5", "above", [])


def test_psalms(spark):
    assert one(spark, "Ps 1, 2 or 3:1-4", grammar.psalm_sets) == ["1, 2", "3:1-4"]
    got = [tuple(e) for e in one(spark, "10:1-4, (5-9), 10-12, 20, [30], 7:3", grammar.psalm_entries)]
    assert got == [(10, 1, 4, False), (10, 5, 9, True), (10, 10, 12, False), (20, None, None, False), (10, 30, 30, True), (7, 3, 3, False)]
    for c, want in (("5", (5, None, None)), ("5:2", (5, 2, 2)), ("5:2-9", (5, 2, 9)), ("x", (None, None, None))):
        assert tuple(one(spark, c, grammar.psalm_citation)) == want


def test_citations(spark):
    for c, want in (("or 1 Mar 2:3-4 or X 1:1", ("1 Mar", "2:3-4")), ("Jude 3-5", ("Jude", "3-5")), ("none", None)):
        got = one(spark, c, grammar.citation)
        assert (got and tuple(got)) == want
    ranges = lambda s: [tuple(r) for r in one(spark, s, grammar.verse_ranges)]
    assert ranges("1:1-10, 12, 2:3—3:5, 7a") == [(1, 1, 1, 10), (1, 12, 1, 12), (2, 3, 3, 5), (3, 7, 3, 7)]
    assert ranges("1:2—2:3, 5") == [(1, 2, 2, 3), (2, 5, 2, 5)]
    assert ranges("5, (6)") == [] and ranges("3:9-4") == [(3, 9, 3, 4)] and ranges("1:2b-4a, (6-8)") == [(1, 2, 1, 4), (1, 6, 1, 8)]


def test_collect_references(spark):
    got = [(c.of, c.pages) for c in one(spark, "388 (Com Ann: 438/9 or FAS 12) or (Mem: 99/100)", grammar.commemoration_pages)]
    assert got == [("Ann", ["438", "439"]), ("", ["99", "100"])]
    assert one(spark, "388/9", grammar.collect_page) == "388" and one(spark, "above", grammar.collect_page) is None
    assert one(spark, "x Collect of the Day: O lamp, shine. Amen More", grammar.inline_collect) == "O lamp, shine. Amen."
    assert [tuple(n) for n in one(spark, "[rubric] a<br>b", grammar.notes)] == [("rubric", "a"), ("pastoral", "b")]
