"""The composite: one lazy plan from a date to the ordered rows of its office."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferial.functions import grammar as g
from ferial.functions.dates import week_index, weekday
from ferial.operators.calendar import as_of, form_key, season_intervals
from ferial.operators.lookup import verses_in_ranges
from ferial.operators.packed import unpacked
from ferial.runtime import checkpoint, written

#: rows of psalms that a task makes, and bytes of psalm lines that are broadcast; beyond, entries and lines meet by shuffle
PSALM_ROWS = 1_000_000
MAX_LINES_BYTES = 64_000_000


def _key(df: DataFrame) -> list[str]:
    """What names a day: its date, within a calendar where there are several."""
    return ["calendar_id", "date"] if "calendar_id" in df.columns else ["date"]


def parse_days(raw: DataFrame) -> DataFrame:
    """Calendar rows ``([calendar_id,] date, name, eucharist, morning, evening, extra)`` as days."""
    meta = g.name_meta(F.try_element_at(g.observance_lines(F.col("name")), F.lit(1)))
    return raw.select(
        *_key(raw), meta.getField("name").alias("name"), meta.getField("rank").alias("rank"), meta.getField("colour").alias("colour"),
        g.commemorations(F.col("name")).alias("commemorations"), g.inline_collect(F.col("eucharist")).alias("collect_inline"),
        g.notes(F.col("extra")).alias("notes"), "morning", "evening",
    )


def day_offices(days: DataFrame) -> DataFrame:
    """One row per day, office and slot (primary, alternate, alternate_2, …) with the parsed fields."""
    key = _key(days)
    offices = days.select(*key, F.explode(F.array(F.struct(F.lit("mp").alias("office"), F.col("morning").alias("raw")), F.struct(F.lit("ep").alias("office"), F.col("evening").alias("raw")))).alias("o"))
    laid = offices.select(*key, "o.office", unpacked(F.col("o.raw")).alias("raw"))
    branches = laid.select(*key, "office", F.posexplode(g.office_branches(F.col("raw"))).alias("i", "branch")).where("branch <> ''")
    slot = F.when(F.col("i") == 0, "primary").when(F.col("i") == 1, "alternate").otherwise(F.concat(F.lit("alternate_"), F.col("i")))
    return branches.select(*key, "office", slot.alias("slot"), g.office_fields(F.col("branch"), "\n").alias("f")).select(*key, "office", "slot", "f.*")


def with_seasons(days: DataFrame, bounds: DataFrame) -> DataFrame:
    """Days with their season, the season of their form, and the week in the season."""
    out = as_of(days, "date", season_intervals(bounds), "season", F.lit("OrdinaryTime"))
    out = as_of(out, "date", season_intervals(bounds, form=True).withColumnRenamed("season", "form_season"), "form_season", F.lit("OrdinaryTime"))
    first = season_intervals(bounds).groupBy("season").agg(F.min("start").alias("__first"))
    return out.join(F.broadcast(first), "season", "left").withColumn("week", week_index(F.col("date"), F.col("__first"))).drop("__first")


def psalm_rows(offices: DataFrame, psalm_verses: DataFrame) -> DataFrame:
    """Appointed verses of ``psalm_verses (num, v, text)``; all of a psalm where no verses are named."""
    key = [*_key(offices), "office", "slot"]
    sets = offices.select(*key, F.posexplode(g.psalm_sets(F.col("psalms"))).alias("choice", "tokens"))
    entries = written(sets.select(*key, "choice", F.posexplode(g.psalm_entries(F.col("tokens"))).alias("ord", "e")).select(*key, "choice", "ord", "e.*").where("num IS NOT NULL"))
    lines = written(psalm_verses.where("num IS NOT NULL"))
    # few psalms, each with many entries and many lines: tasks are cut by the rows they make, not by the bytes they read
    per = lines.groupBy("num").agg(F.count("*").alias("__n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32).alias("__b"))
    made = per.join(entries.groupBy("num").agg(F.count("*").alias("__m")), "num", "left").select((F.col("__m") * F.col("__n")).alias("__rows"), "__b")
    total, most, size = made.agg(F.sum("__rows"), F.max("__rows"), F.sum("__b")).first()
    parts, turn = -(-(total or 0) // PSALM_ROWS) or 1, F.xxhash64(*key, "choice", "ord")
    inside = F.col("first").isNull() | F.col("v").between(F.col("first"), F.col("last"))
    if (size or 0) <= MAX_LINES_BYTES:
        # neighbouring numbers stay together, so that a file holds the lines of few psalms
        met = entries.repartitionByRange(parts, F.col("num"), turn).join(F.broadcast(lines), "num")
    else:
        k = -(-most // PSALM_ROWS)
        salted = entries.withColumn("__s", F.pmod(turn, F.lit(k)).cast("int")).repartition(parts, "num", "__s")
        met = salted.join(lines.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).repartition(parts, "num", "__s"), ["num", "__s"])
    return met.where(inside).select(*key, "choice", "ord", "num", "v", "optional", "text")


def lesson_rows(offices: DataFrame, verses: DataFrame, books: DataFrame) -> DataFrame:
    """Appointed verses of ``verses (book, ch, v, text)``; ``books (abbrev, book)`` resolves abbreviations."""
    key = [*_key(offices), "office", "slot"]
    lessons = offices.select(*key, F.posexplode("lessons").alias("ord", "l"))
    cited = lessons.select(*key, "ord", F.col("l.optional").alias("optional"), g.citation(F.col("l.citation")).alias("c"))
    named = cited.join(books, F.col("c.book") == F.col("abbrev")).select(*key, "ord", "optional", "book", F.posexplode(g.verse_ranges(F.col("c.rest"))).alias("part", "r"))
    flat = named.select(*key, "ord", "optional", "book", "part", "r.*")
    return verses_in_ranges(flat, verses).select(*key, "ord", "part", "optional", "book", "ch", "v", "text")


def bind_forms(keyed: DataFrame, editions: DataFrame) -> DataFrame:
    """``keyed (…, date, form)`` with ``form`` the edition that serves: those of ``editions (key, form)`` take turns.

    No table ties an edition to a calendar, so the rule is stated here: the editions of a key, in order of their names, follow one another
    day by day, and each calendar starts at a place of its own. A key without editions keeps its name.
    """
    turns = editions.select(F.col("key").alias("__key"), F.col("form").alias("__form")).distinct()
    w = Window.partitionBy("__key")
    turns = turns.withColumn("__turn", F.row_number().over(w.orderBy("__form")) - 1).withColumn("__n", F.count("*").over(w))
    sizes = turns.select(F.col("__key").alias("form"), "__n").distinct()
    start = F.crc32("calendar_id") if "calendar_id" in keyed.columns else F.lit(0)
    placed = keyed.join(sizes, "form", "left").withColumn("__at", F.pmod(F.unix_date("date") + start, F.col("__n")))
    found = placed.drop("__n").join(turns.drop("__n"), (F.col("form") == F.col("__key")) & (F.col("__at") == F.col("__turn")), "left")
    return found.withColumn("form", F.coalesce("__form", "form")).drop("__key", "__form", "__turn", "__at")


def assemble(
    days: DataFrame, bounds: DataFrame, forms: DataFrame, psalm_verses: DataFrame, verses: DataFrame, books: DataFrame, collects: DataFrame, editions: DataFrame | None = None
) -> DataFrame:
    """``[calendar_id,] date, office, slot, choice, part, ord, kind, label, text``: the rendered rows of every office.

    Every branch of a field is a slot with all its rows, the form's among them. ``choice`` counts the psalm sets that ``or``
    divides and is 0 elsewhere; ``label`` names the group of alternatives a form's row stands in. Parts in order: 1 the
    form's segments before the readings, 2 psalms, 3 lessons, 4 the collect (by page, else the day's own), 5 the form's
    segments after them. A lesson of which no verse is found is one row of kind ``citation``. Empty parts have no rows; a
    day whose form is missing keeps its own rows.
    """
    key = _key(days)
    spot = [*key, "office", "slot"]
    part = lambda n, kind, ord_, choice=F.lit(0), label=F.lit(None).cast("string"), text="text": [
        *spot, choice.alias("choice"), n.alias("part"), ord_.cast("bigint").alias("ord"), kind.alias("kind"), label.alias("label"), text
    ]
    offices = checkpoint(day_offices(days))  # read by each part
    placed = with_seasons(days.select(*key, "collect_inline"), bounds)
    keyed = placed.select(*key, "form_season", "collect_inline").join(offices.select(*spot, "collect"), key)
    keyed = keyed.withColumn("form", form_key(F.col("form_season"), F.col("office"), weekday(F.col("date"))))
    bound = keyed if editions is None else bind_forms(keyed, editions)
    text = forms.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.col("kind") == "alternatives"))
    label = F.col("group_label") if "group_label" in forms.columns else F.lit(None).cast("string")
    body = bound.join(text, "form").select(part(F.when(F.col("section_ord") < 10, 1).otherwise(5), F.col("kind"), F.col("section_ord") * 10_000 + F.col("seq"), label=label))
    psalms = psalm_rows(offices, psalm_verses).select(part(F.lit(2), F.lit("psalm"), F.col("ord") * 10_000 + F.col("v"), F.col("choice")))
    found = written(lesson_rows(offices, verses, books))  # read for its rows and for what has none
    at = F.col("ord").cast("bigint") * 100_000_000
    lessons = found.select(part(F.lit(3), F.lit("lesson"), at + F.col("part") * 1_000_000 + F.col("ch") * 1_000 + F.col("v")))
    cited = offices.select(*spot, F.posexplode("lessons").alias("ord", "l")).select(*spot, "ord", F.col("l.citation").alias("text"))
    cited = cited.join(found.select(*spot, "ord").distinct(), [*spot, "ord"], "left_anti").select(part(F.lit(3), F.lit("citation"), at))
    page = keyed.withColumn("page", g.collect_page(F.col("collect"))).join(collects.select("page", F.col("text").alias("__t")), "page", "left")
    collect = page.withColumn("text", F.coalesce("__t", "collect_inline")).where("text IS NOT NULL").select(part(F.lit(4), F.lit("collect"), F.lit(0)))
    return body.unionByName(psalms).unionByName(lessons).unionByName(cited).unionByName(collect)


def rendered_text(rows: DataFrame) -> DataFrame:
    """One text per day and office: that of its primary branch with the first psalm set."""
    items = F.array_sort(F.collect_list(F.struct("part", "ord", "text")))
    return rows.where("slot = 'primary' AND choice = 0").groupBy(*_key(rows), "office").agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("text"))
