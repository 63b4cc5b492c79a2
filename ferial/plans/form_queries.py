"""Queries over the rules of forms and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferial.functions.dates import weekday
from ferial.plans import forms, office, slate
from ferial.runtime import small

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_HEADS = [("(?i)^psalm", "psalm"), ("^$", None), ("(?i)^(?:or|one of)", None), ("(?i)silence|kneel", "prayers")]


@query(f"""
    SELECT seg_id, CASE WHEN regexp_matches(coalesce(text, 'x'), '(?i)^psalm') THEN 'psalm' WHEN regexp_matches(coalesce(text, 'x'), '^$') THEN NULL WHEN regexp_matches(coalesce(text, 'x'), '(?i)^(?:or|one of)') THEN NULL
        WHEN regexp_matches(coalesce(text, 'x'), '(?i)silence|kneel') THEN 'prayers' ELSE 'continue' END AS section FROM {slate._SEG}""")
def heading_sections(spark, d):
    return slate._segments(spark, d).select("seg_id", forms.heading_section(F.col("text"), _HEADS).alias("section"))


_WORDS = [("bells", "Advent"), ("gate", "Lent"), ("sheaf", "Pentecost")]


@query(f"""SELECT row_id, CASE WHEN contains(lower(name), 'bells') THEN 'Advent' WHEN contains(lower(name), 'gate') THEN 'Lent' WHEN contains(lower(name), 'sheaf') THEN 'Pentecost' ELSE 'OrdinaryTime' END AS season FROM {slate._CAL}""")
def seasons_by_name(spark, d):
    return slate._calendar(spark, d).select("row_id", forms.season_of_name(F.col("name"), _WORDS).alias("season"))


@query(f"""
    WITH u AS (SELECT DISTINCT cal_date, row_id, ord, x AS tag FROM {slate._unnest('cal_date, row_id', "regexp_extract_all(name, '(Gate|Sheaf|Bells|Door)', 1)", f'{slate._CAL} WHERE name IS NOT NULL')})
    SELECT DISTINCT tag, 'unknown' AS problem FROM u WHERE tag NOT IN ('Gate', 'Bells') UNION ALL SELECT DISTINCT tag, 'repeated' FROM (SELECT cal_date, tag FROM u GROUP BY 1, 2 HAVING count(*) > 1)""")
def tag_hygiene(spark, d):
    """Every tag word of every name."""
    found = F.explode(F.regexp_extract_all("name", F.lit("(Gate|Sheaf|Bells|Door)"), F.lit(1)))
    return forms.tag_hygiene(slate._calendar(spark, d).select("cal_date", found.alias("tag")), "cal_date", "tag", small(spark, [("Gate",), ("Bells",)], "v string"))


@query(f"""
    WITH a AS (SELECT cal_date, min(name) AS name, min(morning) AS morning FROM {slate._CAL} WHERE calendar_id < 'cal_0000013' GROUP BY 1), b AS (SELECT cal_date, min(name) AS name, min(morning) AS morning FROM {slate._CAL} WHERE NOT calendar_id < 'cal_0000013' GROUP BY 1),
         j AS (SELECT coalesce(a.cal_date, b.cal_date) AS cal_date, a.cal_date IS NOT NULL AS x, b.cal_date IS NOT NULL AS y, a.name AS an, b.name AS bn, a.morning AS am, b.morning AS bm FROM a FULL JOIN b ON a.cal_date = b.cal_date)
    SELECT cal_date, CASE WHEN NOT x THEN 'no_a' WHEN NOT y THEN 'no_b' WHEN an IS NOT DISTINCT FROM bn AND am IS NOT DISTINCT FROM bm THEN 'ok' END AS outcome, NULL AS field FROM j WHERE NOT x OR NOT y OR (an IS NOT DISTINCT FROM bn AND am IS NOT DISTINCT FROM bm)
    UNION ALL SELECT cal_date, 'diff', 'name' FROM j WHERE x AND y AND an IS DISTINCT FROM bn UNION ALL SELECT cal_date, 'diff', 'morning' FROM j WHERE x AND y AND am IS DISTINCT FROM bm""")
def compare_days(spark, d):
    def half(k):
        first = F.col("calendar_id") < "cal_0000013"
        return slate._calendar(spark, d).where(~first if k else first).groupBy("cal_date").agg(F.min("name").alias("name"), F.min("morning").alias("morning"))

    return forms.compare_sources(half(0), half(1), "cal_date", ["name", "morning"])


_SPECS = [("a", "Advent", None), ("b", "Lent", 3), ("c", "Nowhere", None), ("d", "OrdinaryTime", 0)]


@query(f"""
    WITH x AS (SELECT cal_date, {slate._season_case(True)} AS season, CAST(dayofweek(cal_date) AS INT) AS weekday FROM {slate._CAL} GROUP BY 1 HAVING bool_or(trim(coalesce(morning, '')) <> '') AND bool_or(trim(coalesce(evening, '')) <> '')),
         h AS (SELECT s.spec, x.cal_date, row_number() OVER (PARTITION BY spec ORDER BY cal_date) - 1 AS r, count(*) OVER (PARTITION BY spec) AS n FROM ({slate._values(_SPECS)}) s(spec, season, weekday) JOIN x ON x.season = s.season AND (s.weekday IS NULL OR s.weekday = x.weekday))
    SELECT s.spec, h.cal_date AS date FROM ({slate._values(_SPECS)}) s(spec, season, weekday) LEFT JOIN h ON h.spec = s.spec AND h.r = h.n // 2 WHERE h.spec IS NOT NULL OR s.spec NOT IN (SELECT spec FROM h)""")
def qa_day_binding(spark, d):
    has = lambda c: F.bool_or(F.trim(F.coalesce(F.col(c), F.lit(""))) != "").alias(c)
    held = slate._calendar(spark, d).groupBy(F.col("cal_date").alias("date")).agg(has("morning"), has("evening"))
    bounds = small(spark, slate._BOUNDS, "key string, d string").select("key", F.to_date("d").alias("start"))
    days = office.with_seasons(held, bounds).select("date", F.col("form_season").alias("season"), weekday(F.col("date")).alias("weekday"), "morning", "evening")
    bound, open_ = forms.bind_days(small(spark, _SPECS, "spec string, season string, weekday int"), days)
    return bound.unionByName(open_.withColumn("date", F.lit(None).cast("date")))


@query(f"""
    WITH l AS (SELECT *, TRY_CAST(psalm AS INT) AS number FROM {slate._PSA} WHERE TRY_CAST(psalm AS INT) IS NOT NULL)
    SELECT psalter, number, CASE WHEN number <= 41 THEN 1 WHEN number <= 72 THEN 2 WHEN number <= 89 THEN 3 WHEN number <= 106 THEN 4 WHEN number <= 150 THEN 5 END AS book,
        arg_min(title, (page_no, seq, line_id)) FILTER (type = 'head') AS title,
        coalesce(string_agg(CASE WHEN type = 'cont' THEN '  ' || trim(text, ' ') ELSE text END, chr(10) ORDER BY page_no, seq, line_id) FILTER (type IN ('cont', 'verse')), '') AS text FROM l GROUP BY 1, 2""")
def psalter_assembly(spark, d):
    return forms.assemble_psalter(slate._psalter(spark, d), ["psalter"], ["page_no", "seq", "line_id"])


@query(f"SELECT shared_key, min(section) AS content FROM {slate._SEG} WHERE kind = 'shared' AND shared_key IS NOT NULL AND section IS NOT NULL GROUP BY 1 HAVING count(DISTINCT section) = 1 AND count(DISTINCT form) > 1")
def hoisted_blocks(spark, d):
    """Shared blocks that all forms refer to from the same section."""
    return forms.hoist_if_agreed(slate._segments(spark, d).where("kind = 'shared' AND shared_key IS NOT NULL AND section IS NOT NULL"), "shared_key", "form", F.col("section"))


_CLEAN = slate._STRIPPED.format(r"replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(name, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&')").replace('\\"', '"')
_JOINED = rf"regexp_replace({_CLEAN}, '( - (?:PF|HD|Mem|Com)(?: \([^()]*\))?) and ([^\n]* - (?:PF|HD|Mem|Com)\b)', '\1' || chr(10) || '\2', 'g')"
_LINES = slate._unnest("row_id", f"list_filter(list_transform(string_split({_JOINED}, chr(10)), lambda x: trim(x)), lambda x: x <> '')", f"{slate._CAL} WHERE name IS NOT NULL")


@query(rf"""
    WITH l AS (SELECT row_id, ord AS line, x FROM {_LINES}),
         b AS (SELECT *, trim(regexp_extract(CASE WHEN regexp_matches(x, '\([^()]*\)[^()]*$') THEN rtrim(regexp_extract(x, '^(.*)\([^()]*\)[^()]*$', 1)) || regexp_extract(x, '\([^()]*\)([^()]*)$', 1) ELSE x END, '^([^\[]*)', 1)) AS body FROM l),
         e AS (SELECT *, nullif(regexp_extract(lower(trim(regexp_replace(body, ' - (?:PF|HD|Mem|Com)$', ''))), '^eve of (?:the )?(.+)$', 1), '') AS eve FROM b),
         h AS (SELECT row_id, line, tag, row_number() OVER (PARTITION BY row_id, line ORDER BY length(p) DESC, p) AS n FROM e JOIN ({slate._values(slate._PHRASES)}) t(p, tag) ON contains(lower(x), p))
    SELECT e.row_id, e.line, CASE WHEN eve = 'embers' THEN NULL WHEN eve IS NOT NULL THEN 'eve_of:' || CASE WHEN eve = 'kept door' THEN 'the ' ELSE '' END || eve ELSE h.tag END AS tag,
        coalesce(eve IN ('nine bells', 'first sheaf', 'kept door', 'embers'), true) AS known FROM e LEFT JOIN h ON h.row_id = e.row_id AND h.line = e.line AND h.n = 1""")
def observance_tags(spark, d):
    phrases = small(spark, slate._PHRASES, "phrase string, tag string")
    return forms.observance_tags(slate._calendar(spark, d), "row_id", "name", phrases, ["nine bells", "first sheaf"], ["kept door"], ["embers"])
