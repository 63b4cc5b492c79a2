import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ferial.operators import audit, calendar, corrections, geometry, hot, lookup, segments


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# calendar


def test_seasons_open_and_close(spark):
    b = spark.createDataFrame([("advent_i", "2030-12-01"), ("christmas", "2030-12-25"), ("palm_sunday", "2031-04-06"), ("easter", "2031-04-13"), ("ascension", "2031-05-22"), ("pentecost", "2031-06-01"), ("trinity_sunday", "2031-06-08")], "key string, d string").select("key", F.to_date("d").alias("start"))
    d = spark.createDataFrame([("2030-11-30",), ("2030-12-01",), ("2031-04-06",), ("2031-05-25",), ("2031-06-08",), ("2031-06-09",), (None,)], "d string").select(F.to_date("d").alias("date"))
    got = {str(r.date): r.season for r in calendar.as_of(d, "date", calendar.season_intervals(b), "season", F.lit("OrdinaryTime")).collect()}
    assert got == {"2030-11-30": "OrdinaryTime", "2030-12-01": "Advent", "2031-04-06": "Passiontide", "2031-05-25": "Easter", "2031-06-08": "Pentecost", "2031-06-09": "OrdinaryTime", "None": "OrdinaryTime"}
    form = {str(r.date): r.season for r in calendar.as_of(d, "date", calendar.season_intervals(b, form=True), "season").collect()}
    assert form["2031-05-25"] == "Pentecost" and form["2030-11-30"] is None


def test_sorted_as_of_equals_the_broadcast_one(spark):
    iv = spark.createDataFrame([(f"p{i}", i * 10, i * 10 + (7 if i % 3 else 10) if i < 19 else None) for i in range(20)], "v string, start int, end int")
    df = spark.createDataFrame([(i, i * 7 % 230 - 5) for i in range(400)] + [(500, None)], "id int, t int")
    a = rows(calendar.as_of(df, "t", iv, "v"), "id", "v")
    assert a == rows(calendar.as_of(df, "t", iv, "v", max_rows=3), "id", "v")
    assert calendar.as_of(df.limit(0), "t", iv, "v", max_rows=3).count() == 0


def test_as_of_with_overlapping_intervals(spark):
    # a short one inside a long one, two that open together, an open end, a null start
    iv = spark.createDataFrame([("long", 0, 100), ("short", 10, 20), ("b", 40, 50), ("a", 40, 60), ("c", 40, 60), ("open", 70, None), ("lost", None, 5)], "v string, start int, end int")
    df = spark.createDataFrame([(i, i) for i in range(-3, 120)] + [(500, None)], "start int, t int")
    want = {t: "long" if 0 <= t < 10 else "short" if 10 <= t < 20 else "c" if 40 <= t < 60 else "open" if t >= 70 else None for t in range(-3, 120)} | {None: None}
    for most in (10, 2):
        assert {r.t: r.v for r in calendar.as_of(df, "t", iv, "v", max_rows=most).collect()} == want, most
    same = calendar.as_of(df.withColumn("v", F.lit("old")), "t", iv, "v", F.lit("none"), max_rows=2)
    assert {r.t: r.v for r in same.collect()} == {t: v or "none" for t, v in want.items()} and same.columns == ["start", "t", "v"]


def test_order_in_large_keys(spark, monkeypatch):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 5 + ["b", None]), rng.choice([*range(40), None]), i, rng.choice(["x", "y", None, None])) for i in range(900)]
    df = spark.createDataFrame(data, "k string, a int, i int, m string")
    stamp = df.withColumn("a", F.timestamp_seconds("a")).withColumn("d", F.date_add(F.lit("2030-01-01"), F.col("i")))
    run = lambda: (
        rows(calendar.middle_pick(df, "k", ["a", "i"]), "k", "i"), rows(calendar.middle_pick(stamp, "k", ["a", "i"]), "k", "i"), rows(calendar.middle_pick(stamp, "k", ["d"]), "k", "i"),
        rows(segments.forward_fill(df, ["k"], ["a", "i"], F.col("m"), "m2"), "i", "m2"),
    )
    small = run()
    want = {}
    for k in ("hot", "b", None):
        held = sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want[k] = (held[len(held) // 2][2], held)
    assert small[0] == small[1] == sorted(((k, v[0]) for k, v in want.items()), key=str)
    last = []
    for _, held in want.values():
        m = None
        for r in held:
            m = r[3] or m
            last.append((r[2], m))
    assert small[3] == sorted(last, key=str)
    monkeypatch.setattr(hot, "LARGE", 50)
    assert run() == small
    assert calendar.middle_pick(df.limit(0), "k", ["a"]).count() == 0


def test_days(spark):
    d = spark.createDataFrame([(date(2031, 1, 1), "a"), (date(2031, 1, 2), "b"), (date(2031, 1, 5), "c"), (date(2031, 1, 5), "d")], "date date, k string")
    assert rows(calendar.missing_dates(d, "date"), "date") == [(date(2031, 1, 3),), (date(2031, 1, 4),)]
    assert rows(calendar.next_day(d.where("k <> 'd'"), "date", ["k"]), "k", "next_k") == [("a", "b"), ("b", None), ("c", None)]
    assert calendar.missing_dates(d.limit(0), "date").count() == 0
    n = calendar.nth_occurrence(d.withColumn("g", F.lit(1)), "g", "date", 3).first()
    assert (n.occurrence_2, n.occurrence_3) == (date(2031, 1, 2), date(2031, 1, 5))
    assert rows(calendar.middle_pick(d.withColumn("g", F.lit(1)), "g", ["date", "k"]), "k") == [("c",)]


# lookup


def test_ranked_contains_tiers(spark):
    keys = spark.createDataFrame([("Richard",), ("Richard Hooker",), ("Clement of Rome",), ("A.B+",), ("Ann",)], "key string")
    names = spark.createDataFrame([("richard",), ("Saint Richard Hooker and Ann",), ("Clement",), ("Richardson",), ("x a.b+ y",), ("Joann",), (None,)], "name string")
    got = {r.name: (r.key, r.tier) for r in lookup.ranked_contains(names, "name", keys, "key").collect()}
    assert got == {"richard": ("Richard", 1), "Saint Richard Hooker and Ann": ("Richard Hooker", 2), "Clement": ("Clement of Rome", 3), "x a.b+ y": ("A.B+", 2)}
    people = rows(lookup.distinct_people(names.where("name LIKE 'Saint%'"), "name", keys, "key"), "key")
    assert people == [("Ann",), ("Richard Hooker",)]


def test_many_keys_join_by_letters(spark, monkeypatch):
    """Beyond the bound of the broadcast the same rows come out, short keys and names included."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abAé.") for _ in range(rng.randint(1, 4)))
    some = lambda n, m: [(" ".join(word() for _ in range(rng.randint(1, m))),) for _ in range(n)]
    keys = spark.createDataFrame([*some(30, 2), ("a",), ("",), (None,)], "key string")
    names = spark.createDataFrame([*some(80, 4), (None,), ("",)], "name string")
    tags = keys.where("key IS NOT NULL").select("key", F.upper("key").alias("tag"))
    run = lambda: (
        rows(lookup.ranked_contains(names, "name", keys, "key"), "name", "key", "tier"), rows(lookup.distinct_people(names, "name", keys, "key"), "name", "key", "at"),
        rows(lookup.longest_phrase(names, "name", tags, "key", "tag"), "name", "tag"),
    )
    few = run()
    monkeypatch.setattr(lookup, "MAX_KEYS", 2)
    assert run() == few and all(len(x) > 20 for x in few)


def test_verse_ranges_span_chapters(spark):
    v = spark.createDataFrame([("B", c, n, f"{c}:{n}") for c in (1, 2, 3) for n in range(1, 4)], "book string, ch int, v int, text string")
    r = spark.createDataFrame([("x", "B", 1, 3, 3, 1), ("y", "B", 2, 3, 2, 1), ("z", "C", 1, 1, 9, 9)], "id string, book string, start_ch int, start_v int, end_ch int, end_v int")
    got = rows(lookup.verses_in_ranges(r, v), "id", "text")
    assert got == [("x", "1:3"), ("x", "2:1"), ("x", "2:2"), ("x", "2:3"), ("x", "3:1")]


def test_paragraphs_drop_what_precedes_the_first_break(spark):
    v = spark.createDataFrame([("B", 1, n) for n in range(1, 6)] + [("B", 2, 1)], "book string, ch int, v int")
    b = spark.createDataFrame([("B", 1, 2), ("B", 1, 4)], "book string, ch int, first_v int")
    assert rows(lookup.paragraphs(v, b), "ch", "v", "first_v") == [(1, 2, 2), (1, 3, 2), (1, 4, 4), (1, 5, 4), (2, 1, None)]


def test_fallback_and_phrases(spark):
    w = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "b")], "k int, v string")
    assert rows(lookup.fallback(w, a, b, "k", "v"), "k", "v", "source") == [(1, "a", "first"), (2, "b", "second"), (3, None, "none")]
    p = spark.createDataFrame([("gate", "g"), ("Quiet Gate", "q")], "p string, tag string")
    t = spark.createDataFrame([("the quiet gate",), ("a gate",), ("none",), (None,)], "t string")
    assert rows(lookup.longest_phrase(t, "t", p, "p", "tag"), "t", "tag") == [("a gate", "g"), ("none", None), ("the quiet gate", "q"), (None, None)]


# segments


def test_dereference_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "gone"), ("d", None)], "key string, target string")
    r = spark.createDataFrame([("f", "a"), ("g", "d"), ("h", "lost")], "root string, key string")
    got = rows(segments.dereference(e, r), "root", "key", "depth", "found")
    assert got == [("f", "a", 1, True), ("f", "b", 2, True), ("f", "c", 3, True), ("f", "gone", 4, False), ("g", "d", 1, True), ("h", "lost", 1, False)]


def test_dereference_has_no_depth_limit(spark):
    e = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(60)] + [("k60", None)], "key string, target string")
    r = spark.createDataFrame([("f", "k0"), ("g", "k58"), ("g", "k59"), ("n", None)], "root string, key string")
    got = rows(segments.dereference(e, r), "root", "key", "depth", "found")
    assert [x for x in got if x[0] == "f"] == sorted(("f", f"k{i}", i + 1, True) for i in range(61))
    assert [x for x in got if x[0] == "g"] == [("g", "k58", 1, True), ("g", "k59", 1, True), ("g", "k60", 2, True)]
    assert segments.dereference(e.limit(0), r).count() == 3 and segments.dereference(e, r.limit(0)).count() == 0


def seg(spark, *rows_):
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows_)], "form string, seq int, kind string, text string")


def test_runs_and_merges(spark):
    s = seg(spark, ("leader", "a"), ("leader", "b"), ("rubric", "Or"), ("rubric", "c"), ("leader", "d continues"), ("leader", "e"), (None, None), (None, None))
    assert rows(segments.merge_runs(s, ["form"], ["seq"], "kind", "text", "/"), "run", "text", "merged") == [(1, "a/b", 2), (2, "Or/c", 2), (3, "d continues/e", 2), (4, "", 2)]
    m = rows(segments.merge_segments(s.where("kind IS NOT NULL"), ["form"], ["seq"]), "seq", "kind", "text")
    assert m == [(0, "leader", "a\nb"), (1, "rubric", "Or\nc"), (2, "leader", "d continues\ne")]
    t = seg(spark, *[("rubric", x) for x in ("Stand.", "Or", "The Song of Dusk", "Kneel.", "Evening Prayer continues", "with the Psalm.", "Sit.", "One of the following", "Bow.")], ("leader", " "))
    texts = [x[1] for x in rows(segments.merge_segments(t, ["form"], ["seq"]), "seq", "text")]
    # a bare Or takes its name, and is then an ordinary named option that takes nothing more in
    assert texts == ["Stand.", "Or\nThe Song of Dusk", "Kneel.", "Evening Prayer continues with the Psalm.", "Sit.", "One of the following", "Bow."]


def test_alternation_resets_at_groups(spark):
    s = seg(spark, ("leader", "a"), ("rubric", "r"), ("leader", "b"), ("leader", "c")).withColumn("g", F.when(F.col("seq") < 2, 1).otherwise(2))
    assert rows(segments.alternation_breaks(s, ["form"], ["seq"], "g"), "seq") == [(3,)]


def test_period_pick(spark):
    s = seg(spark, ("label", "h"), ("leader", "w0"), ("rubric", "m1"), ("leader", "w1"), ("rubric", "m2"), ("leader", "w2"))

    def pick(df, i):
        return [r[0] for r in rows(segments.period_pick(df, ["form"], ["seq"], F.col("kind") == "rubric", F.col("kind") == "label", F.lit(i)), "text")]

    assert pick(s, 0) == ["h", "w0"] and pick(s, 1) == ["h", "m1", "w1"] and pick(s, 9) == ["h", "m2", "w2"] and pick(s, -1) == ["h", "w0"]
    t = s.where("text <> 'w0'")
    assert pick(t, 0) == ["h", "m1", "w1"] and pick(t, 1) == ["h", "m2", "w2"]
    assert len(pick(s.where("kind <> 'rubric'"), 5)) == 4


def test_lines_and_positions(spark):
    s = seg(spark, ("v", ""), ("v", "one *"), ("v", "two"), ("v", ""), ("v", " "), ("v", "three"), ("v", " four"), ("v", ""))
    assert rows(segments.continuation_lines(s, ["form"], ["seq"], "text"), "seq", "continued") == [(1, False), (2, True), (3, False), (5, False), (6, True)]
    r = seg(spark, ("leader", "a"), ("rubric", "b"), ("label", "c"), ("rubric", "d"), ("rubric", "e"))
    assert rows(segments.trailing_rubrics(r, ["form"], ["seq"]).where("trailing"), "seq") == [(3,), (4,)]
    assert rows(segments.split_at(r, ["form"], ["seq"], F.col("kind") == "label").where("after"), "text") == [("c",), ("d",), ("e",)]
    assert rows(segments.reposition(r, ["form"], ["seq"], F.col("kind") == "label"), "seq", "text")[0] == (0, "c")
    f = segments.forward_fill(r, ["form"], ["seq"], F.when(F.col("kind") == "label", F.col("text")), "m")
    assert rows(f, "seq", "m")[1:4] == [(1, None), (2, "c"), (3, "c")]


def test_alternatives_and_roman(spark):
    s = seg(spark, ("leader", "a"), ("rubric", "Or"), ("leader", "b"), ("rubric", "Or Short form"), ("leader", "c"))
    assert rows(segments.group_alternatives(s, ["form"], ["seq"]), "text", "group_no", "label") == [("a", 1, "I"), ("b", 2, "II"), ("c", 3, "Short form")]
    n = spark.createDataFrame([(4,), (1999,), (88,)], "n int").select(segments.roman(F.col("n")).alias("r"))
    assert [r[0] for r in n.collect()] == ["IV", "MCMXCIX", "LXXXVIII"]


def test_first_copies(spark):
    s = spark.createDataFrame([("k", 1, "a  b"), ("k", 2, "a b"), ("k", 3, "x"), ("j", 1, "y")], "key string, o int, t string")
    first, differ = segments.first_copies(s, "key", ["o"], F.col("t"))
    assert rows(first, "key", "t") == [("j", "y"), ("k", "a  b")] and rows(differ, "o") == [(3,)]


# corrections

FIX = "id string, form string, ord int, old string, new string, count int"


def test_corrections(spark):
    s = spark.createDataFrame([("f", 1, "aa b"), ("g", 2, "b"), ("_s", 3, "b"), ("f", 4, None)], "form string, id_ int, text string")
    c = spark.createDataFrame([("1", "f", 1, "a", "b", 2), ("2", "*", 2, "b", "c", None), ("3", "x", 3, "q", "r", None)], FIX)
    assert rows(corrections.apply_replacements(s, c, "form", "id_", "text"), "id_", "text") == [(1, "cc c"), (2, "c"), (3, "b"), (4, None)]
    assert rows(corrections.occurrence_check(s, c, "form", "text"), "id", "found", "outcome") == [("1", 2, "ok"), ("2", 2, "count"), ("3", 0, "miss")]
    with pytest.raises(corrections.CorrectionError) as e:
        corrections.apply_checked(s, c, "form", "id_", "text")
    assert e.value.misses.count() == 2
    assert rows(corrections.apply_checked(s, c.where("id = '1'"), "form", "id_", "text"), "id_", "text")[0] == (1, "bb b")
    assert rows(corrections.unmatched(s, c.where("form <> '*'"), ["form"]), "id") == [("3",)]


def test_equality_and_provenance(spark):
    s = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    c = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "z", "w")], "k int, old string, new string")
    assert rows(corrections.replace_equal(s, c, ["k"], "v"), "k", "v", "outcome") == [(1, "x", "applied"), (2, "y", "applied"), (3, "c", "stale")]
    p = spark.createDataFrame([("1", "print", "r"), ("1", "web", " "), (None, "print", "r")], "id string, source string, reason string")
    assert rows(corrections.provenance(p, ["print"]), "id", "problem") == [("1", "no reason"), ("1", "repeated id"), ("1", "repeated id"), ("1", "unknown source"), (None, "no id")]
    t = spark.createDataFrame([("abcabc",), ("x",)], "t string").select(corrections.first_occurrence(F.col("t"), F.lit("bc"), F.lit("-")))
    assert [r[0] for r in t.collect()] == ["a-abc", "x"]


# audits


def test_corrections_in_blocks(spark, monkeypatch):
    """More corrections of every row than go to a task at once are applied in turn, in their order."""
    s = spark.createDataFrame([("f", 1, "a"), ("g", 2, "ab"), ("_s", 3, "a")], "form string, id_ int, text string")
    c = [(str(i), "*" if i % 3 else "f", i, chr(97 + i), chr(98 + i), 1) for i in range(12)]
    df = spark.createDataFrame(c, FIX)
    whole = rows(corrections.apply_replacements(s, df, "form", "id_", "text"), "id_", "text")
    checked = rows(corrections.occurrence_check(s, df, "form", "text"), "id", "found")
    assert whole == [(1, "m"), (2, "ad"), (3, "a")]
    monkeypatch.setattr(corrections, "MAX_CORRECTIONS", 2)
    assert len(corrections._blocks(df, "form")) > 2
    assert rows(corrections.apply_replacements(s, df, "form", "id_", "text"), "id_", "text") == whole
    assert rows(corrections.occurrence_check(s, df, "form", "text"), "id", "found") == checked


def test_outliers_and_minorities(spark):
    d = spark.createDataFrame([("p", i, 10.0) for i in range(9)] + [("p", 9, 99.0), ("q", 1, 5.0), ("r", 1, 1.0), ("r", 2, 1.0)], "peer string, id int, v double")
    assert rows(audit.peer_zscore(d, ["peer"], "v"), "peer", "id", "z") == [("p", 9, 3.0)]
    # by hand: 0 stands out among peers with a positive mean; 1, 2 and 4 lie within two deviations of 1.75
    zero = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate((0, 4, 1, 2))], "peer string, id int, v double")
    assert rows(audit.peer_zscore(zero, ["peer"], "v"), "id", "z") == [(0, None)]
    # five equal values and one apart: it lies exactly sqrt(5) = 2.236 deviations away; of four and one exactly 2.0, which is not more than 2
    for n, found in ((5, [(9, 2.2)]), (4, [])):
        near = spark.createDataFrame([("p", i, 10.0) for i in range(n)] + [("p", 9, 30.0)], "peer string, id int, v double")
        assert rows(audit.peer_zscore(near, ["peer"], "v"), "id", "z") == found
    low = spark.createDataFrame([("p", 1, 0.0), ("p", 2, -4.0), ("p", 3, None)], "peer string, id int, v double")
    assert audit.peer_zscore(low, ["peer"], "v").count() == 0
    b = spark.createDataFrame([("p", 1, True), ("p", 2, True), ("p", 3, False), ("t", 1, True), ("t", 2, False), ("u", 1, True)], "peer string, id int, f boolean")
    assert rows(audit.boolean_minority(b, ["peer"], "f"), "peer", "id") == [("p", 3), ("t", 1)]


def test_scores(spark):
    f = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3), (None, 2), ("x", 9)] + [("d", 1)] * 12, "form string, tier int")
    o = spark.createDataFrame([("a", "m", 3.0, False), ("b", "m", 2.9, False), ("c", "m", None, False), ("e", "m", 9.0, False), ("g", "f", None, True), ("e", "f", None, True)], "form string, metric string, z double, flag boolean")
    e = spark.createDataFrame([("e", "m"), ("e", "f"), ("b", "other")], "form string, metric string")
    lost = spark.createDataFrame([("h",), ("c",)], "form string")
    # a: 100-10-3-15; b: 100-10-5; c: 100-5-5-100; e: all exempt; g: alone with a flag
    want = [("__global__", 97), ("a", 72), ("b", 85), ("c", 0), ("d", 0), ("e", 100), ("g", 95), ("h", 0), ("x", 100)]
    assert rows(audit.penalty_scores(f, o, e, lost), "form", "score") == want
    s = audit.penalty_scores(f)
    assert rows(s.where("form < 'd'"), "form", "score") == [("__global__", 97), ("a", 87), ("b", 90), ("c", 95)]
    assert audit.overall(s).first()[0] == 0 and audit.overall(s.limit(0)).first()[0] == 100


def test_reconciliations(spark):
    f = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "k string")
    w = spark.createDataFrame([("a",), ("c",)], "k string")
    assert rows(audit.waivers(f, w, ["k"]), "k", "outcome") == [("a", "waived"), ("b", "fail"), ("c", "stale"), ("d", "fail")]
    k = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "k string, lines int")
    assert rows(audit.baseline(f, k, ["k"]), "k", "outcome") == [("a", "known"), ("b", "count"), ("c", "stale"), ("d", "new")]


def test_conservation(spark):
    a = spark.createDataFrame([("u", "same"), ("u", "a  b"), ("u", "inner"), ("u", "lost"), ("v", "same"), ("u", None)], "unit string, t string")
    b = spark.createDataFrame([("u", "same"), ("u", "a b"), ("u", "the inner part"), ("w", "lost")], "unit string, t string")
    assert rows(audit.conservation(a, b, "unit", "t"), "unit", "line", "rule") == [("u", "a  b", "whitespace"), ("u", "inner", "part"), ("u", "lost", "unaccounted"), ("u", "same", "verbatim"), ("v", "same", "unaccounted")]


def test_multisets(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, "x"), ("p", 3, "y"), ("q", 1, "m"), ("q", 2, "n")], "part string, o int, t string")
    b = spark.createDataFrame([("p", 1, "x"), ("p", 2, "z"), ("q", 1, "n"), ("q", 2, "m")], "part string, o int, t string")
    assert rows(audit.multiset_diff(a, b, ["part"], ["t"]), "old", "new", "change") == [("x", "z", "modified"), ("y", None, "removed")]
    assert rows(audit.moved(a, b, ["part"], "o", ["t"]), "part") == [("q",)]


def test_small_audits(spark):
    d = spark.createDataFrame([("g", float(i)) for i in range(200)], "g string, v double")
    assert audit.nearest_rank(d, ["g"], "v", 0.995).first().quantile == 199.0
    c = spark.createDataFrame([("A", "x", "d1"), ("A", None, "d2"), ("B", "", "d3")], "n string, d string, t string")
    assert rows(audit.collision_keys(c, "n", "d", "t"), "key") == [("A (d2)",), ("A, x",), ("B",)]
    s = spark.createDataFrame([("f", "a"), ("g", "b")], "form string, section string")
    assert rows(audit.required_missing(s, "form", "section", ["a", "b"]), "form", "section") == [("f", "b"), ("g", "a")]
    assert rows(audit.duplicates(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "id int, t string"), "id", F.col("t")), "id", "first_id") == [(3, 1)]
    audit.gate([s.limit(0)])
    with pytest.raises(audit.GateError, match="section"):
        audit.gate([s.limit(0), s])
    many = spark.range(250).select(F.concat(F.lit("section "), "id").alias("section"))
    with pytest.raises(audit.GateError, match="^252 findings") as e:
        audit.gate([s, many])
    assert e.value.findings.count() == 252 and str(e.value).count("section") >= 100


# geometry


def test_geometry(spark):
    s = spark.createDataFrame([(1, 50.0, 10.0, "b"), (1, 10.0, 12.0, "a"), (1, 10.0, 30.0, "c"), (2, 1.0, 1.0, None)], "page int, x0 double, y0 double, text string")
    assert rows(geometry.lines_of(s), "page", "line", "text") == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "")]
    t = spark.createDataFrame(
        [("v", 0, "forced", 0.0, 1.0, -4.0), ("v", 1, "chosen", 0.0, 1.0, 4.0), ("v", 2, "unsure", 0.0, 1.0, 1.0), ("v", 3, "named  join", None, None, -1.0), ("v", 4, "page end", 0.0, 80.0, None), ("v", 5, "para", 16.0, 1.0, -9.0), ("v", 6, "last", 0.0, 0.0, 0.0),
         ("p", 0, "wrap", 0.0, 1.0, 59.0), ("p", 1, "off page", 0.0, 90.0, None), ("p", 2, "short", 0.0, 1.0, 60.0), ("p", 3, "end", 20.0, 0.0, 0.0), ("p", 4, None, 0.0, 0.0, 0.0)],
        "u string, seq int, text string, lead double, gap double, slack double",
    )
    got = rows(geometry.reflow(t, ["u"], ["seq"], F.col("u") == "p", join=("named  join",)), "u", "text", "undecided")
    assert got == [("p", "wrap off page short\nend", 0), ("v", "forced chosen\nunsure\nnamed join page end\npara\n\nlast", 1)]
    p = spark.createDataFrame([("a", 3), ("b", 9)], "k string, start int")
    assert rows(geometry.page_bounds(p, "start", 20), "k", "end") == [("a", 8), ("b", 20)]
    k = spark.createDataFrame([(8.0, 0, 0), (11.0, 0, 0xC00000), (14.0, 0, 0), (11.0, 16, 0), (11.0, 0, 0)], "s double, f int, c int")
    assert [r[0] for r in k.select(geometry.span_kind(F.col("s"), F.col("f"), F.col("c"))).collect()] == ["footer", "rubric", "heading", "response", "leader"]
    assert geometry.text_margin(spark.createDataFrame([(1, 5.0), (3, 9.0), (2, 1.0)], "page int, x double"), "page", "x").count() == 2
