from datetime import date

from pyspark.sql import functions as F

from ferial.plans import forms


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def values(spark, data, build):
    df = spark.createDataFrame([(x,) for x in data], "x string")
    return [r[0] for r in df.select(build(F.col("x"))).collect()]


def test_lines(spark):
    rules = [("(?i)^psalm", "psalm"), ("^x", None)]
    assert values(spark, ["Psalm 1", "xx", "y", None], lambda c: forms.heading_section(c, rules)) == ["psalm", None, "continue", "continue"]
    assert values(spark, ["Lent II", "other"], lambda c: forms.season_of_name(c, [("lent", "Lent")])) == ["Lent", "OrdinaryTime"]
    assert values(spark, ["Proper 12", "x"], forms.proper_number) == [12, None]
    assert values(spark, ["12 January", " May 3 ", "3 May x"], forms.is_date_line) == [True, True, False]
    assert values(spark, ["Mt 1:2–3", "Matthew 1:2-3", "5"], forms.citation_key) == ["1:2-3", "1:2-3", "5"]
    assert values(spark, ["Stand.", None], lambda c: forms.suppressed(c, ["^Stand"])) == [True, False]
    assert values(spark, ["41", "42", "150", "151"], lambda c: forms.book_of_psalm(c.cast("int"))) == [1, 2, 5, None]
    t = spark.createDataFrame([("A", None, ["B", "C"]), ("A", "O", [])], "n string, o string, c array<string>")
    assert [r[0] for r in t.select(forms.day_title(F.col("n"), F.col("o"), F.col("c"))).collect()] == ["A · Commemorating B, C", "A · O"]


def test_classes_may_overlap(spark):
    df = spark.createDataFrame([("ab",), ("b",), ("c",)], "t string")
    got = forms.by_class(df, [("a", F.col("t").contains("a")), ("b", F.col("t").contains("b"))])
    assert rows(got, "t", "class") == [("ab", "a"), ("ab", "b"), ("b", "b")]


def test_observances(spark):
    df = spark.createDataFrame([(1, "Eve of the Kept Door - PF<br>Feast of the Quiet Gate"), (2, "Eve of Embers<br>Eve of Nowhere"), (3, None)], "id int, name string")
    p = spark.createDataFrame([("gate", "g"), ("quiet gate", "qg")], "phrase string, tag string")
    got = rows(forms.observance_tags(df, "id", "name", p, ["x"], ["kept door"], ["embers"]), "id", "line", "tag", "known")
    assert got == [(1, 0, "eve_of:the kept door", True), (1, 1, "qg", True), (2, 0, None, True), (2, 1, "eve_of:nowhere", False)]


def test_openings_and_options(spark):
    s = spark.createDataFrame([("Lent", "morning", 1, "L"), (None, "morning", 1, "O"), (None, "evening", 1, "E")], "grp string, time string, ord int, text string")
    d = spark.createDataFrame([("d1", "mp", "Lent"), ("d1", "ep", "Lent"), ("d2", "mp", "OrdinaryTime")], "date string, office string, form_season string")
    assert rows(forms.penitential(s, d), "date", "office", "text") == [("d1", "ep", "E"), ("d1", "mp", "L"), ("d2", "mp", "O")]
    m = spark.createDataFrame([("opening", None, 0, "rubric", "Except in Lent, add"), ("opening", None, 1, "response", "Alleluia!"), ("reading", 1, 2, "leader", "text"), ("reading", 1, 3, "rubric", "Gal 5")], "block string, group_no int, seq int, kind string, text string")
    assert rows(forms.midday(m, F.lit("Lent")), "block", "seq", "kind", "text") == [("reading", 0, "label", "Gal 5"), ("reading", 1, "leader", "text")]
    assert forms.midday(m, F.lit("Easter")).count() == 3
    o = spark.createDataFrame([("d1", "r", "i", "s", "e", None), ("d2", None, None, "s", None, "o")], "date string, by_ref string, inline string, saint string, seasonal string, occasional string")
    assert rows(forms.collect_options(o), "date", "ord", "option", "text") == [("d1", 0, "reference", "r"), ("d1", 1, "seasonal", "e"), ("d2", 0, "saint", "s"), ("d2", 1, "occasional", "o")]


def test_groups(spark):
    g = spark.createDataFrame([(1, [["a"], ["b", "c", "d"]]), (2, [["a"], ["b"]])], "k int, groups array<array<string>>")
    got = {r.k: (r.groups, r.body) for r in forms.split_common_body(g, "groups").collect()}
    assert got == {1: ([["a"], ["b"]], ["c", "d"]), 2: ([["a"], ["b"]], None)}
    s = spark.createDataFrame([("u", i, t) for i, t in enumerate(["Lent", "* a", "b", "* c", "Easter", "* d"])], "u string, seq int, text string")
    got = forms.grouped_items(s, ["u"], ["seq"], F.col("text").isin("Lent", "Easter"), F.col("text").startswith("*"))
    assert rows(got, "text", "grp", "item") == [("* a", "Lent", 1), ("* c", "Lent", 2), ("* d", "Easter", 1), ("b", "Lent", 1)]
    h = spark.createDataFrame([("k", "f", "x"), ("k", "g", "x"), ("j", "f", "x"), ("j", "g", "y"), ("i", "f", "x")], "key string, form string, t string")
    assert rows(forms.hoist_if_agreed(h, "key", "form", F.col("t")), "key", "content") == [("k", "x")]


def test_comparison_and_binding(spark):
    a = spark.createDataFrame([(1, "x", "1:2–3"), (2, "y", None), (3, "z", None)], "k int, n string, c string")
    b = spark.createDataFrame([(1, "x", "1:2-3"), (2, "q", "5"), (4, "z", None)], "k int, n string, c string")
    t = {"c": (forms.citation_key(F.col("a_c")), forms.citation_key(F.col("b_c")))}
    assert rows(forms.compare_sources(a, b, "k", ["n", "c"], t), "k", "outcome", "field") == [(1, "ok", None), (2, "diff", "c"), (2, "diff", "n"), (3, "no_b", None), (4, "no_a", None)]
    d = spark.createDataFrame([(date(2030, 1, i), "Lent", i % 7, True, True) for i in range(1, 8)] + [(date(2030, 1, i), "Lent", 2, i == 8, i == 9) for i in range(8, 20)], "date date, season string, weekday int, morning boolean, evening boolean")
    s = spark.createDataFrame([("m", "Lent", None), ("w", "Lent", 2), ("n", "Easter", None)], "spec string, season string, weekday int")
    bound, missing = forms.bind_days(s, d)
    assert rows(bound, "spec", "date") == [("m", date(2030, 1, 4)), ("w", date(2030, 1, 2))] and rows(missing, "spec") == [("n",)]
    tags = spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "z"), ("d", None)], "date string, tag string")
    assert rows(forms.tag_hygiene(tags, "date", "tag", spark.createDataFrame([("a",)], "v string")), "tag", "problem") == [("a", "repeated"), ("z", "unknown")]
