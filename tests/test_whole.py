"""Queries and operators do the whole of their tables, by brute force on small rows."""

from datetime import date

from ferial.operators import segments
from ferial.plans import office, slate


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_every_calendar_branch_and_choice(spark):
    day = date(2030, 12, 1)
    raw = spark.createDataFrame(
        [("c1", day, "Sunday", None, "'Ps 1' | Bk 1:1 | the reading<br>Or<br>Ps 2 or 3; Coll 7<br>Or<br>Ps 3", None, None), ("c2", day, "Sunday", None, "Ps 2", "Ps 3", None)],
        "calendar_id string, date date, name string, eucharist string, morning string, evening string, extra string",
    )
    bounds = spark.createDataFrame([("advent_i", "2030-12-01")], "key string, d string").selectExpr("key", "to_date(d) AS start")
    forms = spark.createDataFrame([(f"f{i}", 1, 0, "leader", f"open {i}", None) for i in range(3)], "form string, section_ord int, seq int, kind string, text string, group_label string")
    editions = spark.createDataFrame([("advent-mp", f"f{i}") for i in range(3)], "key string, form string")
    psalms = spark.createDataFrame([(n, 1, f"p{n}") for n in (1, 2, 3)], "num int, v int, text string")
    verses = spark.createDataFrame([("Book", 1, 1, "1:1")], "book string, ch int, v int, text string")
    books = spark.createDataFrame([("Bk", "Book")], "abbrev string, book string")
    collects = spark.createDataFrame([("7", "Seven.")], "page string, text string")
    out = office.assemble(office.parse_days(raw), bounds, forms, psalms, verses, books, collects, editions).collect()
    got = sorted((r.calendar_id, r.office, r.slot, r.choice, r.kind, r.text) for r in out if r.kind != "leader")
    assert got == [
        ("c1", "mp", "alternate", 0, "collect", "Seven."), ("c1", "mp", "alternate", 0, "psalm", "p2"), ("c1", "mp", "alternate", 1, "psalm", "p3"), ("c1", "mp", "alternate_2", 0, "psalm", "p3"),
        ("c1", "mp", "primary", 0, "citation", "the reading"), ("c1", "mp", "primary", 0, "lesson", "1:1"), ("c1", "mp", "primary", 0, "psalm", "p1"),
        ("c2", "ep", "primary", 0, "psalm", "p3"), ("c2", "mp", "primary", 0, "psalm", "p2"),
    ]
    opened = {(r.calendar_id, r.slot): r.text for r in out if r.kind == "leader"}
    assert set(opened) == {("c1", "primary"), ("c1", "alternate"), ("c1", "alternate_2"), ("c2", "primary")}


def test_editions_take_turns(spark):
    keyed = spark.createDataFrame([(date(2030, 12, d), "advent-mp") for d in (1, 2, 3, 4)] + [(date(2030, 12, 1), "lent-mp")], "date date, form string")
    editions = spark.createDataFrame([("advent-mp", f"f{i}") for i in range(3)], "key string, form string")
    got = [r.form for r in office.bind_forms(keyed, editions).orderBy("form", "date").collect()]
    assert len(got) == 5 and set(got) == {"f0", "f1", "f2", "lent-mp"}


def test_shared_blocks_are_expanded(spark):
    block = "key string, seq int, kind string, text string, group_label string, shared_key string"
    blocks = spark.createDataFrame([("a", 0, "leader", "A0", None, None), ("a", 1, "shared", None, None, "b"), ("a", 2, "leader", "A2", "I", None), ("b", 0, "response", "B", None, None), ("b", 1, "shared", None, None, "a")], block)
    rows = spark.createDataFrame([("f", 1, "s", 0, "leader", "x", None, None), ("f", 1, "s", 1, "shared", None, None, "a"), ("f", 1, "s", 2, "leader", "y", None, None), ("f", 1, "s", 3, "shared", None, None, "none")], "form string, section_ord int, section string, seq int, kind string, text string, group_label string, shared_key string")
    got = [(r.seq, r.kind, r.text) for r in segments.expand_shared(rows, blocks).orderBy("seq").collect()]
    assert got == [(0, "leader", "x"), (1, "leader", "A0"), (2, "response", "B"), (3, "unresolved", "a"), (4, "leader", "A2"), (5, "leader", "y"), (6, "unresolved", "none")]


def calendar(spark, folder, rows):
    """Calendar rows ``(row_id, name, morning, evening)``."""
    df = spark.createDataFrame([(i, "c", date(2030, 12, 1), f"f{i % 2}", n, None, m, e, None, None) for i, n, m, e in rows], "row_id long, calendar_id string, cal_date date, src_file string, name string, eucharist string, morning string, evening string, extra string, loaded_at timestamp")
    save(df, folder, "calendar_rows")


def psalter(spark, folder):
    lines = [("psalter_common", "1", 7, s, "verse") for s in (1, 2, 3)] + [("psalter_common", "2", 7, 4, "verse"), ("psalter_common", "2", 7, 5, "cont"), ("psalter_b", "9", 7, 1, "verse")]
    save(spark.createDataFrame([(i, *x, None, f"t{i}") for i, x in enumerate(lines)], "line_id long, psalter string, psalm string, page_no int, seq int, type string, title string, text string"), folder, "psalter_lines")


def test_appointed_psalms_all(spark, tmp_path):
    d = str(tmp_path)
    calendar(spark, d, [(1, "x", "'Ps 1:1-2, (3), 2' | Bk 1:2", "Ps 2<br>Or<br>Ps 1 or 9"), (2, "x", " Ps 1; Coll 3", None), (3, "x", "Bk 1:1", "")])
    psalter(spark, d)
    got = sorted((r.row_id, r.office, r.slot, r.choice, r.ord, r.num, r.verses) for r in slate.appointed_psalms_all(spark, d).collect())
    assert got == [
        (1, "ep", "alternate", 0, 0, 1, 3), (1, "ep", "alternate", 1, 0, 9, 0), (1, "ep", "primary", 0, 0, 2, 1),
        (1, "mp", "primary", 0, 0, 1, 2), (1, "mp", "primary", 0, 1, 1, 1), (1, "mp", "primary", 0, 2, 2, 1), (2, "mp", "primary", 0, 0, 1, 3),
    ]


def test_read_more_keeps_every_script(spark, tmp_path):
    d, texts = str(tmp_path), {1: "plain", 2: "Sérvael " * 20, 3: "ж" * 120, 4: None}
    rows = [(i, "f", "s", 1, i, str(i), 0, None, None, "leader", t, None, None) for i, t in texts.items()]
    save(spark.createDataFrame(rows, "seg_id long, form string, section string, section_ord int, seq int, path string, depth int, group_no int, group_label string, kind string, text string, shared_key string, loaded_at timestamp"), d, "segments")
    got = {r.seg_id: r.cut for r in slate.read_more(spark, d).collect()}
    assert got == {1: "plain", 2: ("Sérvael " * 10).rstrip(), 3: "ж" * 80}


def test_upsert_deliveries_takes_every_row(spark, tmp_path):
    d = str(tmp_path)
    days = [(1, "c", 1, "a"), (7, "c", 1, "b"), (11, "c", 2, "a"), (13, "c", 3, "b"), (17, "e", 1, "a"), (19, "e", 1, "a")]
    df = spark.createDataFrame([(i, c, date(2030, 12, n), f, None) for i, c, n, f in days], "row_id long, calendar_id string, cal_date date, src_file string, loaded_at timestamp")
    save(df, d, "calendar_rows")
    assert sorted(r.row_id for r in slate.upsert_deliveries(spark, d).collect()) == [7, 11, 13, 19]


def test_geometry_lines_of_every_psalter(spark, tmp_path):
    d = str(tmp_path)
    psalter(spark, d)
    got = sorted((r.psalter, r.psalm, r.page, r.line, r.text) for r in slate.geometry_lines(spark, d).collect())
    assert got == [("psalter_b", "9", 7, 0, "t5"), *[("psalter_common", "1", 7, i, f"t{i}") for i in range(3)], ("psalter_common", "2", 7, 0, "t3"), ("psalter_common", "2", 7, 1, "t4")]


def test_every_part_of_a_name_and_field(spark, tmp_path):
    d = str(tmp_path)
    calendar(spark, d, [(1, "Feast of Xyzzy - HD (Red) / 'Eve of the Quiet Gater - Mem'; Blessed A (Blue)", "Ps 1:2-3, (5) | Ps 9", "Ps 4 or 6"), (2, None, None, "Coll 1")])
    got = [(r.row_id, r.ord, r.name, r.rank, r.colour) for r in slate.name_rank_colour_all(spark, d).orderBy("row_id", "ord").collect()]
    assert got == [(1, 0, "Feast of Xyzzy", "holy_day", "Red"), (1, 1, "Eve of the Quiet Gater", "memorial", None), (1, 2, "Blessed A", "feria", "Blue")]
    entries = sorted((r.office, r.choice, r.ord, r.num, r.first or 0, r.last or 0, r.optional) for r in slate.psalm_entries_all(spark, d).collect())
    assert entries == [("ep", 0, 0, 4, 0, 0, False), ("ep", 1, 0, 6, 0, 0, False), ("mp", 0, 0, 1, 2, 3, False), ("mp", 0, 1, 1, 5, 5, True)]
    calendar(spark, d, [(1, "Feast of Xyzzy; Eve of the Quiet Gat", None, None)])
    assert [(r.n, r.phrase) for r in slate.similarity_nearmiss(spark, d).collect()] == [("quiet gat", "quiet gates")]


def test_every_part_of_the_office_occurs(spark):
    parts = {r.part: r["count"] for r in slate.office_assembly(spark, "/root/testdata/sf0.001").groupBy("part").count().collect()}
    assert set(parts) == {1, 2, 3, 4, 5} and min(parts.values()) > 0
    kinds = {r.kind for r in slate.office_assembly(spark, "/root/testdata/sf0.001").where("part = 3").select("kind").distinct().collect()}
    assert kinds == {"lesson", "citation"}


def test_psalm_rows_are_cut_by_the_rows_they_make(spark, monkeypatch):
    key = "date date, office string, slot string, psalms string"
    offices = spark.createDataFrame([(date(2030, 1 + i // 28, 1 + i % 28), "mp", "primary", f"Ps 1, 2:2-3 or {3 + i % 2}") for i in range(80)], key)
    lines = spark.createDataFrame([(n, v, f"p{n} {v} {copy}") for n in (1, 2, 3) for v in (1, 2, 3, 4) for copy in ("a", "b")], "num int, v int, text string")
    want = sorted((o.date, c, n, v, f"p{n} {v} {copy}") for i, o in enumerate(offices.collect()) for c, n, vs in [(0, 1, (1, 2, 3, 4)), (0, 2, (2, 3)), (1, 3 + i % 2, (1, 2, 3, 4))] if n < 4 for v in vs for copy in ("a", "b"))
    monkeypatch.setattr(office, "PSALM_ROWS", 100, raising=False)
    for most in (office.MAX_LINES_BYTES, 0):  # lines broadcast, and met by shuffle
        monkeypatch.setattr(office, "MAX_LINES_BYTES", most)
        rows = office.psalm_rows(offices, lines)
        assert sorted((r.date, r.choice, r.num, r.v, r.text) for r in rows.collect()) == want
        sizes = [n for n in rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
        assert len(sizes) > 5 and max(sizes) <= 500


def test_office_assembly_reads_its_tables_once(spark):
    read = " ".join(slate.office_assembly(spark, "/root/testdata/sf0.001").inputFiles())
    assert "segments.parquet" not in read and "psalter_lines.parquet" not in read
