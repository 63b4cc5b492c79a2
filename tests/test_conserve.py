import random

from pyspark.sql import functions as F

from ferial.operators import conserve, hot
from ferial.operators.conserve import Chain, accounts, data_to_page, found_in, page_stream, page_to_data

PAGE = "unit string, section string, type string, seq int, text string, used_as string"
SHIPPED = "unit string, section string, type string, text string"
REBUILT = "unit string, before string, after string"


def test_found_in_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    hay = [(rng.choice(["u", "v", None]), text(rng.randint(1, 9))) for _ in range(60)] + [("u", None), ("u", ""), ("hot", "a b")]
    needles = [(rng.choice(["u", "v", None, "w"]), text(rng.randint(1, 5))) for _ in range(80)] + [("u", ""), ("u", None), ("u", "a"), ("u", "ab"), (None, "b c")]
    for u, t in [h for h in hay if h[1] and len(h[1]) > 4]:
        a = rng.randint(0, len(t) - 2)
        needles.append((u, t[a : rng.randint(a + 1, len(t))].strip()))
    got = {tuple(r) for r in found_in(spark.createDataFrame(hay, "unit string, h string"), spark.createDataFrame(needles, "unit string, n string")).collect()}
    assert got == {(u, n) for u, n in needles if n and any(x == u and h and n in h for x, h in hay)} and len(got) > 40
    none = spark.createDataFrame([], "unit string, n string")
    assert found_in(spark.createDataFrame(hay, "unit string, h string"), none).count() == 0


def test_page_to_data(spark):
    shipped = [("f", "a", "leader", "Kept as it is.\nSecond line"), ("f", "a", "leader", "joined over\ntwo lines, here"), ("f", "b", "label", "Song of Dusk"), ("f", "c", "leader", "A line mended"), ("g", "a", "leader", "Lost here.")]
    page = [
        ("Kept  as\u00a0it is.", "a", None, "verbatim"), ("over two", "a", None, "reflowed"), ("two lines , here", "a", None, "whitespace"), ("THE READING", "a", "heading", "heading"), ("Or", "a", None, "separator"),
        ("The Song of Dusk (Bk 1:2)", "a", None, "label"), ("Bk 3:4", "reading", None, "lectionary"), ("Bk 3:4", "reading", "rubric", "UNACCOUNTED"), ("line broken", "a", None, "corrected"), ("line never mended", "a", None, "UNACCOUNTED"),
        ("Lost here.", "a", None, "UNACCOUNTED"), (" \u00a0", "a", None, None), (None, "a", None, None),
    ]
    rows = [("f", s, "leader", i, t, u) for i, (t, s, u, _) in enumerate(page)]
    rebuilt = [("f", "A line broken", "A line mended"), ("f", "A line never mended", "A line elsewhere"), ("g", "x", "y")]
    chain = Chain(fix=lambda c: F.regexp_replace(c, r"\s+,", ","), filled=("reading",))
    got = {r.seq: r.rule for r in page_to_data(spark.createDataFrame(rows, PAGE), spark.createDataFrame(shipped, SHIPPED), chain, spark.createDataFrame(rebuilt, REBUILT)).collect()}
    assert got == {i: rule for i, (_, _, _, rule) in enumerate(page) if rule}
    bare = {r.rule for r in page_to_data(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], SHIPPED)).collect()}
    assert bare == {"heading", "separator", "UNACCOUNTED"}


def test_decomposed_accents_are_the_same_line(spark):
    page = spark.createDataFrame([("f", "a", "leader", 1, "cafe\u0301", None)], PAGE)
    shipped = spark.createDataFrame([("f", "a", "leader", "caf\u00e9")], SHIPPED)
    assert page_to_data(page, shipped).first().rule == "verbatim" and data_to_page(page, shipped, ["seq"]).first().rule == "printed"


def test_data_to_page(spark):
    page = [("f", "a", "leader", 1, "One printed", None), ("f", "a", "leader", 2, "line , and more", None), ("f", "a", "rubric", 3, "The Song of Dusk (Bk 1:2)", None), ("g", "a", "leader", 1, "x", None)]
    shipped = [("f", "a", "leader", t) for t in ("One printed", "printed line", "line, and", "made anew", "made up", "old and made up")] + [("f", "a", "label", t) for t in ("Song of Dusk", "II", "Nowhere")] + [("f", "a", "leader", "Song of Dusk\n \n")]
    rebuilt = [("f", "old text", "made anew"), ("f", "made up", "made up still")]
    chain = Chain(fix=lambda c: F.regexp_replace(c, r"\s+,", ","))
    got = {r.line: r.rule for r in data_to_page(spark.createDataFrame(page, PAGE), spark.createDataFrame(shipped, SHIPPED), ["seq"], chain, spark.createDataFrame(rebuilt, REBUILT)).collect()}
    want = {"One printed": "printed", "printed line": "printed-joined", "line, and": "whitespace", "made anew": "corrected", "made up": "UNACCOUNTED", "old and made up": "UNACCOUNTED", "II": "structural", "Nowhere": "UNACCOUNTED", "Song of Dusk": "printed-joined"}
    assert got == want
    out = accounts(page_to_data(spark.createDataFrame(page, PAGE), spark.createDataFrame(shipped, SHIPPED)), data_to_page(spark.createDataFrame(page, PAGE), spark.createDataFrame(shipped, SHIPPED), ["seq"]))
    assert {(r.direction, r.rule): r.lines for r in out.where("whole").collect()}[("data", "UNACCOUNTED")] == 5


def test_a_page_of_any_length_is_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(hot, "LARGE", 20)
    lines = [("f", i, f"word{i} w{i}" + " x" * (i % 40)) for i in range(400)] + [("g", 0, "alone")]
    df = spark.createDataFrame(lines, "unit string, seq int, text string")
    pieces = page_stream(df, ["seq"], 900)
    assert pieces.where("unit = 'f'").count() > 5 and pieces.agg(F.max(F.length("h"))).first()[0] < 5000
    whole = " ".join(t for u, _, t in lines if u == "f")
    rng = random.Random(1)
    cuts = [whole[a : a + rng.randint(3, 900)].strip() for a in (rng.randint(0, len(whole) - 900) for _ in range(60))]
    got = {r.n for r in found_in(pieces, spark.createDataFrame([("f", c) for c in cuts] + [("g", cuts[0])], "unit string, n string")).where("unit = 'f'").collect()}
    assert got == set(cuts)
    assert conserve.page_stream(df.limit(0), ["seq"], 10).count() == 0
