import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ferial import schemas
from ferial.sources import readers, sinks


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_calendar_csv_keeps_the_last_file(spark, tmp_path):
    (tmp_path / "short_2030.csv").write_text('2030-01-01,"Old, ""A""",,"Ps 1\nOr\nPs 2",e\n2030-01-02,B,,m\nheader,x,y,z,w\n2030-01-03x,C,,m,e,n\n')
    (tmp_path / "short_2031.csv").write_text("2030-01-01,New,,m,e\n")
    df = readers.calendar_csv(spark, str(tmp_path / "short_*.csv"))
    assert rows(df, "date", "name") == [("2030-01-01", "New"), ("2030-01-01", 'Old, "A"'), ("2030-01-03x", "C")]
    assert readers.calendar_csv(spark, str(tmp_path / "short_*.csv"), fields=2).count() == 4
    assert rows(readers.keep_last(df, ["date"], [F.col("src")]).drop("src"), "date", "name", "extra") == [("2030-01-01", "New", None), ("2030-01-03x", "C", "n")]


def test_json_documents(spark, tmp_path):
    (tmp_path / "kjv").mkdir()
    (tmp_path / "kjv" / "1 Mar.json").write_text(json.dumps({"1": {"1": "¹ In ", "2": "b"}, "2": {"1": "c"}}))
    assert rows(readers.scripture(spark, str(tmp_path)), "translation", "book", "ch", "v", "text") == [("kjv", "1 Mar", 1, 1, "In"), ("kjv", "1 Mar", 1, 2, "b"), ("kjv", "1 Mar", 2, 1, "c")]
    (tmp_path / "m.json").write_text(json.dumps({"2030-01-01": {"name": "A"}, "2030-01-02": {}}))
    assert rows(readers.json_by_key(spark, str(tmp_path / "m.json"), "struct<name:string>", "date"), "date", "value.name") == [("2030-01-01", "A"), ("2030-01-02", None)]
    assert readers.optional(spark, str(tmp_path / "none.json"), schemas.SAINTS).count() == 0
    body = json.dumps({"chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "a <S>1</S> b"}]}]})
    d = spark.createDataFrame([("B", body)], "book string, body string")
    assert rows(readers.chapter_arrays(d, "body", "book"), "book", "ch", "v", "text") == [("B", 1, 1, "a 1 b")]
    v = spark.createDataFrame([('"A 1"',), ('{"citation":"B 2","optional":true}',), ("3",)], "j string").select(readers.string_or_object(F.parse_json("j")).alias("c"))
    assert [r.c for r in v.collect()] == ["A 1", "B 2", None]


def test_markup(spark, tmp_path):
    x = '<usfx><book id="GEN"><c id="1"/><p><v id="1"/>a<v id="2"/></p><p><v id="3"/></p><c id="2"/><p><v id="1"/></p></book></usfx>'
    (tmp_path / "b.xml").write_text(x)
    assert rows(readers.usfx_paragraphs(spark, str(tmp_path / "b.xml")), "book", "ch", "first_v") == [("GEN", 1, 1), ("GEN", 1, 3), ("GEN", 2, 1)]
    h = spark.createDataFrame([(1, '<div id="t">A &amp; <b id="u">B</b><br>C<img></div><p id="t">no</p>'), (2, None), (3, '<p id="u">open')], "k int, html string")
    assert rows(readers.html_by_id(h, "html", ["t", "u"]), "k", "t", "u") == [(1, "A & B C", "B"), (2, None, None), (3, None, "open")]
    md = spark.createDataFrame([("d", i, line) for i, line in enumerate(["# One", "```", "x", "y", "```", "## Two", "```", "z", "```", "| a | b |", "|---|:-:|", "| 1 | 2 |"])], "doc string, pos int, line string")
    assert rows(readers.fenced_blocks(md, "doc", "pos", "line"), "block", "heading", "body") == [(1, "One", "x\ny"), (2, "Two", "z")]
    assert [r.cells for r in readers.table_rows(md, "line").collect()] == [["a", "b"], ["1", "2"]]


def test_sinks(spark, tmp_path):
    days = spark.createDataFrame([(date(2030, 1, 1), "a"), (date(2030, 2, 1), "b"), (date(2031, 1, 1), "c")], "date date, name string")
    path = str(tmp_path / "months")
    sinks.write_months(days, path)
    sinks.write_months(days.where("name = 'b'").withColumn("name", F.lit("B")), path)
    back = spark.read.schema("date date, name string, month string").json(path)
    assert rows(back, "name") == [("B",), ("a",), ("c",)]
    assert rows(readers.days_on(back, "2030-02-01"), "name") == [("B",)]
    plan = readers.days_on(back, "2030-02-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    sinks.write_window(days, path, "2030-01-15", 1)
    assert rows(spark.read.schema("date date, name string").json(path), "name") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        sinks.mirror(days.limit(0), str(tmp_path / "m"))
    sinks.mirror(days, str(tmp_path / "m"))
    m = sinks.file_manifest(spark, str(tmp_path / "m" / "*.parquet"))
    assert m.count() > 0 and sinks.composite_hash(m).first().files == m.count()
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "name string, sha256 string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("w", "4")], "name string, sha256 string")
    assert rows(sinks.manifest_drift(a, b), "name", "drift") == [("w", "missing"), ("x", "changed"), ("z", "new")]
    assert sinks.report(a.limit(1)).first().line.startswith('{"name"')


def test_stream_keeps_the_latest(spark, tmp_path):
    from ferial.streaming.deliveries import distinct_deliveries, upsert_stream

    src = tmp_path / "in"
    rows_ = spark.createDataFrame([("a", "2030-01-01 00:00:00", "x"), ("a", "2030-01-02 00:00:00", "y"), ("b", "2030-01-01 00:00:00", "z"), ("b", "2030-01-01 00:00:00", "z")], "k string, t string, v string").select("k", F.col("t").cast("timestamp").alias("t"), "v")
    rows_.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(rows_.schema).parquet(str(src))
    run = lambda: upsert_stream(distinct_deliveries(stream, ["k", "v"], "t", "3 days"), ["k"], "t", str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination()
    run()
    out = lambda: rows(spark.read.parquet(str(tmp_path / "out")), "k", "v")
    assert out() == [("a", "y"), ("b", "z")]
    files = lambda: {f.name for f in (tmp_path / "out").rglob("*.parquet")}
    before = files()
    more = spark.createDataFrame([("c", "2030-01-02 00:00:00", "w"), ("b", "2029-12-31 00:00:00", "old")], "k string, t string, v string").select("k", F.col("t").cast("timestamp").alias("t"), "v")
    more.coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert out() == [("a", "y"), ("b", "z"), ("c", "w")]
    # a folder without new keys is left alone
    touched = {r[0] for r in more.select(F.pmod(F.xxhash64("k"), F.lit(4))).collect()}
    mine = rows_.where("k = 'a'").select(F.pmod(F.xxhash64("k"), F.lit(4))).first()[0]
    assert mine in touched or before & files()
