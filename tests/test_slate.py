"""Every query with a twin against DuckDB on the smallest tables, and the office composite on literal rows."""

import datetime
import os
from collections import Counter
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ferial.plans import office

DATA = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())
#: queries that find nothing in the smallest tables
SPARSE = {"hoisted_blocks", "retention_window"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("needs the test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return repr(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*[F.col(f"`{c}`") for c in cols]).collect())
    assert got or name in SPARSE
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
        assert got == want


def test_entry(spark, con):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(NAMES)


def test_office(spark):
    raw = spark.createDataFrame([(date(2030, 12, 1), "First Sunday - HD (Violet)", "Collect of the Day: Own. Amen.", "Ps 1:1-2, 2 or 3; Bk 1:2—2:1; Coll 7", "Ps 2; Coll above", None)], "date date, name string, eucharist string, morning string, evening string, extra string")
    bounds = spark.createDataFrame([("advent_i", "2030-12-01")], "key string, d string").select("key", F.to_date("d").alias("start"))
    forms = spark.createDataFrame([("advent-mp", 1, 0, "leader", "Open"), ("advent-mp", 12, 0, "response", "Go"), ("advent-mp", 1, 1, "leader", " ")], "form string, section_ord int, seq int, kind string, text string")
    psalms = spark.createDataFrame([(1, v, f"p1:{v}") for v in (1, 2, 3)] + [(2, 1, "p2:1")], "num int, v int, text string")
    verses = spark.createDataFrame([("Book", 1, 1, "1:1"), ("Book", 1, 2, "1:2"), ("Book", 2, 1, "2:1"), ("Book", 2, 2, "2:2")], "book string, ch int, v int, text string")
    books = spark.createDataFrame([("Bk", "Book")], "abbrev string, book string")
    collects = spark.createDataFrame([("7", "Seven.")], "page string, text string")
    days = office.parse_days(raw)
    assert days.first().rank == "holy_day"
    out = office.rendered_text(office.assemble(days, bounds, forms, psalms, verses, books, collects))
    got = {r.office: r.text for r in out.collect()}
    assert got == {"mp": "Open\np1:1\np1:2\np2:1\n1:2\n2:1\nSeven.\nGo", "ep": "p2:1\nOwn. Amen."}
