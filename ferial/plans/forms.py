"""Rules of forms and days: headings, seasons by name, openings, options, comparisons of two sources, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferial.functions import grammar
from ferial.functions.dates import MONTHS
from ferial.operators.calendar import middle_pick
from ferial.operators.lookup import longest_phrase
from ferial.runtime import small

CONTINUE = "continue"
# fixed values: which sentences open the penitential office in a season, and the last psalm of each book
SENTENCE_GROUPS = (
    ("Advent", "Advent, Christmas, and Epiphany"), ("Christmas", "Advent, Christmas, and Epiphany"), ("Epiphany", "Advent, Christmas, and Epiphany"), ("Lent", "Lent"),
    ("Passiontide", "Passiontide"), ("Easter", "Easter"), ("Pentecost", "Pentecost"), ("AllSaints", "All Saints"),
)
BOOK_ENDS = (41, 72, 89, 106, 150)


def heading_section(text: Column, rules: list[tuple[str, str | None]]) -> Column:
    """The section a heading opens, by the first rule that matches: its key, null to discard the line, or ``continue``
    for what is no heading."""
    out = None
    for pattern, key in rules:
        test, value = F.coalesce(text.rlike(pattern), F.lit(False)), F.lit(key).cast("string")
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(CONTINUE) if out is None else out.otherwise(F.lit(CONTINUE))


def season_of_name(name: Column, keywords: list[tuple[str, str]], default: str = "OrdinaryTime") -> Column:
    """The season a collect's name tells, by the first keyword it holds."""
    out = None
    for word, season in keywords:
        test = F.contains(F.lower(name), F.lit(word.lower()))
        out = F.when(test, season) if out is None else out.when(test, season)
    return F.lit(default) if out is None else out.otherwise(default)


def proper_number(name: Column) -> Column:
    return F.regexp_extract(name, r"\bProper (\d+)", 1).try_cast("int")


def is_date_line(line: Column) -> Column:
    """``12 January`` or ``January 12`` alone on a line."""
    return F.trim(line).rlike(rf"^(?:\d{{1,2}} (?:{MONTHS})|(?:{MONTHS}) \d{{1,2}})$")


def section_of_page(page: Column, bounds: list[tuple[int, str]], rest: str) -> Column:
    """The section a page lies in, by the last page of each; ``rest`` after all of them."""
    out = None
    for last, name in bounds:
        out = F.when(page <= last, name) if out is None else out.when(page <= last, name)
    return F.lit(rest) if out is None else F.when(page.isNotNull(), out.otherwise(rest))


def date_in_name(name: Column) -> Column:
    """``12 January`` in a name, but not as the end of a span (``… and 12 January``)."""
    return F.nullif(F.regexp_extract(name, rf"(?<! and )\b(\d{{1,2}} (?:{MONTHS}))\b", 1), F.lit(""))


def date_above(text: Column, marker: str) -> Column:
    """The date in the last line that is not blank above a line that is only ``marker``."""
    above = F.regexp_extract(text, rf"(?ms)\A(.*?)^{marker}[ \t]*$", 1)
    last = F.regexp_extract(F.rtrim(F.regexp_replace(above, r"\s+\z", "")), r"([^\n]*)\z", 1)
    return F.nullif(F.regexp_extract(last, rf"\b(\d{{1,2}} (?:{MONTHS}))\b", 1), F.lit(""))


def day_markers(day: Column, active: Column, observances: Column, commemorations: Column, eve: Column, labels: dict[str, str]) -> Column:
    """What a day's header carries beside its title: the day itself where an eve took the title, eves and labelled tags but for the title's own, and
    those commemorated under the day (``commemorations``: struct of name and coequal)."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    named = F.transform(F.coalesce(observances, F.expr("cast(array() as array<string>)")), lambda t: F.when(t.startswith("eve_of:"), F.concat(F.lit("Eve of "), F.substr(t, F.lit(8)))).otherwise(F.try_element_at(table, t)))
    eves = F.filter(named, lambda x: x.isNotNull() & ~(x.startswith("Eve of ") & (x == active)))
    under = F.transform(F.filter(commemorations, lambda c: ~F.coalesce(c["coequal"], F.lit(False))), lambda c: c["name"])
    own = F.when(eve & (day != active), F.array(day)).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(own, eves, F.coalesce(under, F.expr("cast(array() as array<string>)")))


def _all_groups(groups: Column, test) -> Column:
    return F.coalesce(F.forall(groups, lambda g: F.coalesce(test(g), F.lit(False))), F.lit(False))


def is_doxology(groups: Column) -> Column:
    """Three options that all begin with ``Glory``; ``groups`` is an array of struct(label, segments of struct(type, text))."""
    return (F.size(groups) == 3) & _all_groups(groups, lambda g: F.try_element_at(g["segments"], F.lit(1))["text"].startswith("Glory"))


def is_affirmation(groups: Column) -> Column:
    """Two options, the first labelled as the Apostles'."""
    return (F.size(groups) == 2) & F.coalesce(F.try_element_at(groups, F.lit(1))["label"].startswith("Apostles"), F.lit(False))


def is_blessings(groups: Column) -> Column:
    """Three options of two segments, the first a leader's ``Blessed be``."""
    first = lambda g: F.try_element_at(g["segments"], F.lit(1))
    return (F.size(groups) == 3) & _all_groups(groups, lambda g: (F.size(g["segments"]) == 2) & (first(g)["type"] == "leader") & first(g)["text"].startswith("Blessed be"))


def split_suffix(groups: Column, suffix: str = "\nAlleluia.") -> Column:
    """``struct(groups, cut)``: a closing response that every option has, taken from all of them; unchanged where one lacks it."""
    has = lambda g: (F.try_element_at(g["segments"], F.lit(-1))["type"] == "response") & F.try_element_at(g["segments"], F.lit(-1))["text"].endswith(suffix)
    cut = (F.size(groups) > 0) & _all_groups(groups, has)

    def short(g: Column) -> Column:
        n = F.size(g["segments"])
        return F.struct(g["label"].alias("label"), F.transform(g["segments"], lambda s, i: F.struct(s["type"].alias("type"), F.when(i == n - 1, F.substring(s["text"], F.lit(1), F.length(s["text"]) - len(suffix))).otherwise(s["text"]).alias("text"))).alias("segments"))

    return F.struct(F.when(cut, F.transform(groups, short)).otherwise(groups).alias("groups"), cut.alias("cut"))


def in_fixed_order(groups: Column, order: list[str], labels: tuple[str, ...] = ("I", "II", "III", "IV", "V")) -> Column:
    """Options in the order their first lines have in ``order``, labelled anew; unchanged unless each line of it begins an option."""
    lines_ = F.array(*[F.lit(x) for x in order])
    found = F.transform(lines_, lambda x: F.try_element_at(F.filter(groups, lambda g: F.coalesce(F.try_element_at(g["segments"], F.lit(1))["text"] == x, F.lit(False))), F.lit(-1)))
    names = F.array(*[F.lit(x) for x in labels])
    named = F.transform(found, lambda g, i: F.struct(F.element_at(names, i + 1).alias("label"), g["segments"].alias("segments")))
    return F.when(F.forall(found, lambda g: g.isNotNull()), named).otherwise(groups)


def commemoration_collects(days: DataFrame, ref: str, collects: DataFrame) -> DataFrame:
    """``days`` with ``ord, title, text`` for every page that a collect reference names for a commemoration and ``collects (page, name, text)`` has."""
    pages = days.select("*", F.posexplode(F.flatten(F.transform(grammar.commemoration_pages(F.col(ref)), lambda c: F.transform(c["pages"], lambda p: F.struct(c["of"].alias("of"), p.alias("page")))))).alias("ord", "__c"))
    found = pages.join(collects.select(F.col("page").alias("__p"), F.col("name").alias("__n"), F.col("text").alias("__t")), F.col("__c.page") == F.col("__p"))
    title = F.when(F.col("__c.of") != "", F.concat_ws(": ", F.col("__c.of"), F.col("__n"))).otherwise(F.col("__n"))
    return found.select(*days.columns, "ord", title.alias("title"), F.col("__t").alias("text"))


def citation_key(c: Column) -> Column:
    """What two writings of one citation have in common: its verses, dashes alike, without blanks or the book."""
    return F.regexp_replace(F.translate(F.regexp_extract(c, r"(\d+:.*|\d+)$", 1), "–—‑", "---"), r"\s+", "")


def suppressed(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(text.rlike(p), F.lit(False))
    return out


def by_class(df: DataFrame, classes: list[tuple[str, Column]]) -> DataFrame:
    """Each row once for every class whose test it meets (classes may overlap), in ``class``."""
    hits = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in classes]))
    return df.withColumn("class", F.explode(hits))


def day_title(name: Column, observance: Column, commemorated: Column) -> Column:
    """The header line of a day: its name, the observance chosen and those commemorated, what is missing left out."""
    also = F.when(F.size(commemorated) > 0, F.concat(F.lit("Commemorating "), F.array_join(commemorated, ", ")))
    return F.array_join(F.filter(F.array(name, observance, also), lambda x: x.isNotNull() & (x != "")), " · ")


def observance_tags(df: DataFrame, id_col: str, name: str, phrases: DataFrame, targets: list[str], article: list[str], excluded: list[str]) -> DataFrame:
    """``id, line, tag, known`` for every line of a name field: ``eve_of:[the ]X`` for an eve, else the tag of the longest phrase.

    ``known`` is false for an eve whose target is outside ``targets``; excluded targets have no tag.
    """
    lines = df.select(id_col, F.posexplode(grammar.observance_lines(F.col(name))).alias("line", "text"))
    tagged = longest_phrase(lines, "text", phrases, "phrase", "tag")
    eve = grammar.eve_target(F.col("text"))
    named = F.when(eve.isin(*excluded), None).otherwise(F.concat(F.lit("eve_of:"), F.when(eve.isin(*article), "the ").otherwise(""), eve))
    known = F.coalesce(eve.isin(*targets, *article, *excluded), F.lit(True))
    return tagged.select(id_col, "line", F.when(eve.isNotNull(), named).otherwise(F.col("tag")).alias("tag"), known.alias("known"))


def tag_hygiene(tags: DataFrame, date: str, tag: str, vocabulary: DataFrame) -> DataFrame:
    """``tag, problem``: tags outside the vocabulary, and tags given twice on a date."""
    used = tags.where(F.col(tag).isNotNull())
    unknown = used.select(F.col(tag).alias("tag")).distinct().join(vocabulary.select(F.col(vocabulary.columns[0]).alias("tag")), "tag", "left_anti").withColumn("problem", F.lit("unknown"))
    twice = used.groupBy(date, F.col(tag).alias("tag")).agg(F.count("*").alias("n")).where("n > 1").select("tag", F.lit("repeated").alias("problem")).distinct()
    return unknown.unionByName(twice)


def penitential(sentences: DataFrame, days: DataFrame) -> DataFrame:
    """The opening sentences of each ``(date, office, form_season)`` from ``sentences (grp, time, ord, text)``: the season's
    group at that time of day, else the ordinary ones (a null group)."""
    groups = small(days.sparkSession, list(SENTENCE_GROUPS), "form_season string, grp string")
    time = F.when(F.col("office") == "ep", "evening").otherwise("morning")
    wanted = days.withColumn("time", time).join(groups, "form_season", "left").select("date", "office", "time", "grp")
    own = wanted.join(sentences.where("grp IS NOT NULL"), ["grp", "time"]).select("date", "office", "ord", "text")
    rest = wanted.join(own.select("date", "office").distinct(), ["date", "office"], "left_anti")
    plain = rest.drop("grp").join(sentences.where("grp IS NULL").drop("grp"), "time").select("date", "office", "ord", "text")
    return own.unionByName(plain)


def midday(rows: DataFrame, season: Column) -> DataFrame:
    """The rows of the mid-day office in a season: the note on Lent never shows, its response only outside it, and a
    rubric inside a reading's group leads the group as a label."""
    lent = season.isin("Lent", "Passiontide")
    opening = F.col("block") == "opening"
    note = opening & (F.col("kind") == "rubric") & F.col("text").startswith("Except in Lent")
    hallel = opening & lent & (F.col("kind") == "response") & (F.col("text") == "Alleluia!")
    cited = (F.col("block") == "reading") & (F.col("kind") == "rubric") & F.col("group_no").isNotNull()
    out = rows.where(~F.coalesce(note | hallel, F.lit(False))).withColumn("__c", F.coalesce(cited, F.lit(False)))
    w = Window.partitionBy("block").orderBy("group_no", ~F.col("__c"), "seq")
    return out.withColumn("kind", F.when(F.col("__c"), "label").otherwise(F.col("kind"))).withColumn("seq", F.row_number().over(w) - 1).drop("__c")


def collect_options(days: DataFrame) -> DataFrame:
    """``date, ord, option, text`` in order of precedence: the reference before the inline text; a saint's only where
    neither resolves; seasonal and occasional ones after it. Columns ``by_ref, inline, saint, seasonal, occasional``."""
    daily = F.coalesce("by_ref", "inline")
    kinds = F.array(
        F.struct(F.when(F.col("by_ref").isNotNull(), "reference").otherwise("inline").alias("option"), daily.alias("text")),
        F.struct(F.lit("saint").alias("option"), F.when(daily.isNull(), F.col("saint")).alias("text")),
        F.struct(F.lit("seasonal").alias("option"), F.col("seasonal").alias("text")),
        F.struct(F.lit("occasional").alias("option"), F.col("occasional").alias("text")),
    )
    return days.select("date", F.posexplode(F.filter(kinds, lambda x: x["text"].isNotNull())).alias("ord", "o")).select("date", "ord", "o.*")


def split_common_body(df: DataFrame, groups: str) -> DataFrame:
    """Two-group blocks whose second group runs on: what it has beyond the first one's length is the body common to both."""
    first, second = F.try_element_at(F.col(groups), F.lit(1)), F.try_element_at(F.col(groups), F.lit(2))
    runs_on = (F.size(groups) == 2) & (F.size(second) > F.size(first))
    body = F.when(runs_on, F.slice(second, F.size(first) + 1, F.size(second)))
    kept = F.when(runs_on, F.array(first, F.slice(second, F.lit(1), F.size(first)))).otherwise(F.col(groups))
    return df.withColumn("body", body).withColumn(groups, kept)


def grouped_items(df: DataFrame, part: list[str], order: list[str], head: Column, bullet: Column) -> DataFrame:
    """Lines under the last subhead (``grp``), with the number of the item that the last bullet opened (``item``)."""
    w = Window.partitionBy(*part).orderBy(*order)
    out = df.withColumn("__h", head).withColumn("grp", F.last(F.when(head, F.col("text")), ignorenulls=True).over(w))
    out = out.withColumn("__n", F.sum(F.col("__h").cast("int")).over(w))
    inner = Window.partitionBy(*part, "__n").orderBy(*order)
    return out.withColumn("item", F.sum(bullet.cast("int")).over(inner)).where("NOT __h").drop("__h", "__n")


def book_of_psalm(n: Column) -> Column:
    out = None
    for i, last in enumerate(BOOK_ENDS):
        out = F.when(n <= last, i + 1) if out is None else out.when(n <= last, i + 1)
    return out


def assemble_psalter(lines: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """``part, number, book, title, text`` of psalter lines ``(psalm, type, title, text)``: heads name, verses and their
    continuations make the text, continuations indented."""
    body = F.when(F.col("type") == "cont", F.concat(F.lit("  "), F.trim("text"))).when(F.col("type") == "verse", F.col("text"))
    number = F.col("psalm").try_cast("int")
    items = F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct(*order, body.alias("__t")))))
    title = F.min_by(F.when(F.col("type") == "head", F.col("title")), F.when(F.col("type") == "head", F.struct(*order)))
    out = lines.where(number.isNotNull()).groupBy(*part, number.alias("number")).agg(title.alias("title"), F.array_join(F.transform(items, lambda x: x["__t"]), "\n").alias("text"))
    return out.withColumn("book", book_of_psalm(F.col("number")))


def compare_sources(a: DataFrame, b: DataFrame, key: str, fields: list[str], tolerant: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """``key, outcome, field`` of two sources by ``key``: ok, diff (one row a field), no_a or no_b.

    ``tolerant`` gives for a field the two columns to compare instead, over ``a_<field>`` and ``b_<field>``.
    """
    x = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("__a"))
    y = b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("__b"))
    both = x.join(y, key, "full_outer")
    pair = lambda f: (tolerant or {}).get(f, (F.col(f"a_{f}"), F.col(f"b_{f}")))
    differ = F.array_compact(F.array(*[F.when(~pair(f)[0].eqNullSafe(pair(f)[1]), F.lit(f)) for f in fields]))
    outcome = F.when(F.col("__a").isNull(), F.array(F.lit("no_a"))).when(F.col("__b").isNull(), F.array(F.lit("no_b"))).when(F.size(differ) == 0, F.array(F.lit("ok"))).otherwise(differ)
    out = both.select(key, F.explode(outcome).alias("o"))
    state = F.col("o").isin("no_a", "no_b", "ok")
    return out.select(key, F.when(state, F.col("o")).otherwise("diff").alias("outcome"), F.when(~state, F.col("o")).alias("field"))


def bind_days(specs: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The middle published day of every ``(spec, season, weekday)`` (null: any weekday) among ``days (date, season, weekday, morning,
    evening)`` that have both offices, and the specs without one. ``season`` is the season of the day's forms."""
    days = days.where("morning AND evening")
    s = specs.select("spec", F.col("season").alias("__s"), F.col("weekday").alias("__w"))
    hits = s.join(days, F.col("season") == F.col("__s")).where(F.col("__w").isNull() | (F.col("__w") == F.col("weekday")))
    return middle_pick(hits, "spec", ["date"]).select("spec", "date"), specs.join(hits.select("spec").distinct(), "spec", "left_anti").select("spec")


def hoist_if_agreed(df: DataFrame, key: str, unit: str, content: Column) -> DataFrame:
    """Keys whose content all their units share word for word, with it; others stay where they are."""
    h = F.xxhash64(content)
    out = df.groupBy(key).agg(F.min(h).alias("__a"), F.max(h).alias("__b"), F.min(unit).alias("__u"), F.max(unit).alias("__v"), F.first(content).alias("content"))
    return out.where("__a = __b AND __u <> __v").select(key, "content")
