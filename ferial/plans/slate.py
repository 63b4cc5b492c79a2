"""The query slate: every operator family over whole tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferial.functions import colour, grammar, text
from ferial.functions.dates import week_index, weekday
from ferial.operators import audit, calendar, conserve, corrections, geometry, lookup, segments
from ferial.operators.packed import unpacked
from ferial.operators.rejects import CALENDAR, parse_records
from ferial.plans import coherence, office
from ferial.plans import forms as form_rules
from ferial.runtime import checkpoint, ensure_checkpoint_dir, small, table, written
from ferial.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments without repeated rows."""
    return table(spark, d, "segments").drop("loaded_at").dropDuplicates(["seg_id"])


_SEG = "(SELECT DISTINCT seg_id, form, section, section_ord, seq, path, depth, group_no, group_label, kind, text, shared_key FROM segments)"
_PSA = "(SELECT DISTINCT line_id, psalter, psalm, page_no, seq, type, title, text FROM psalter_lines)"
_CAL = "(SELECT DISTINCT row_id, calendar_id, cal_date, src_file, name, eucharist, morning, evening, extra FROM calendar_rows)"


def _psalter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "psalter_lines").dropDuplicates(["line_id"])


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "calendar_rows").drop("loaded_at").dropDuplicates(["row_id"])


# periods and dates

_PERIODS = [
    ("early", "1995-01-01", "1996-03-01"), ("spring", "1996-03-01", "1997-05-10"), ("summer", "1997-05-11", "1998-08-01"),
    ("harvest", "1998-08-01", "1999-10-20"), ("late", "2000-01-01", None),
]
_PERIOD_SQL = f"(SELECT season, CAST(s AS DATE) AS s, CAST(e AS DATE) AS e FROM ({_values(_PERIODS)}) t(season, s, e))"


def _periods(spark: SparkSession) -> DataFrame:
    return small(spark, _PERIODS, "season string, s string, e string").select("season", F.to_date("s").alias("start"), F.to_date("e").alias("end"))


@query(f"""
    SELECT coalesce(p.season, 'ordinary') AS season, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM orders LEFT JOIN {_PERIOD_SQL} p ON CAST(o_orderdate AS DATE) >= p.s AND (p.e IS NULL OR CAST(o_orderdate AS DATE) < p.e) GROUP BY 1""")
def boundary_asof(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    out = calendar.as_of(o, "day", _periods(spark), "season", F.lit("ordinary"))
    return out.groupBy("season").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(ORACLE["boundary_asof"])
def boundary_asof_sorted(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    out = calendar.as_of_sorted(o, "day", _periods(spark), "season", F.lit("ordinary"))
    return out.groupBy("season").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_BOUNDS = [
    ("advent_i", "2030-12-01"), ("christmas", "2030-12-25"), ("epiphany", "2031-01-12"), ("presentation", "2031-02-02"), ("ash_wednesday", "2031-02-26"),
    ("palm_sunday", "2031-04-06"), ("easter", "2031-04-13"), ("ascension", "2031-05-22"), ("pentecost", "2031-06-01"), ("trinity_sunday", "2031-06-08"),
    ("all_saints", "2031-11-01"), ("advent_ii", "2031-11-30"), ("christmas_ii", "2031-12-25"),
]


def _season_case(form: bool) -> str:
    b = dict(_BOUNDS)
    steps = [("christmas_ii", ">=", "Christmas"), ("advent_ii", ">=", "Advent"), ("all_saints", ">=", "AllSaints"), ("trinity_sunday", ">", "OrdinaryTime"),
             ("ascension" if form else "pentecost", ">=", "Pentecost"), ("easter", ">=", "Easter"), ("palm_sunday", ">=", "Passiontide"), ("ash_wednesday", ">=", "Lent")]
    steps += [("presentation", ">=", "OrdinaryTime")] if form else []
    steps += [("epiphany", ">=", "Epiphany"), ("christmas", ">=", "Christmas"), ("advent_i", ">=", "Advent")]
    return "CASE " + " ".join(f"WHEN cal_date {op} DATE '{b[k]}' THEN '{s}'" for k, op, s in steps) + " ELSE 'OrdinaryTime' END"


def _seasons(spark, d):
    days = _calendar(spark, d).select(F.col("cal_date").alias("date"), "row_id")
    bounds = small(spark, _BOUNDS, "key string, d string").select("key", F.to_date("d").alias("start"))
    return office.with_seasons(days, bounds)


@query(f"SELECT {_season_case(False)} AS season, {_season_case(True)} AS form_season, count(*) AS days FROM {_CAL} GROUP BY 1, 2")
def season_of_day(spark, d):
    return _seasons(spark, d).groupBy("season", "form_season").agg(F.count("*").alias("days"))


@query(f"""
    SELECT CASE WHEN s = 'OrdinaryTime' THEN 'ordinary-' || ['sunday','monday','tuesday','wednesday','thursday','friday','saturday'][CAST(dayofweek(cal_date) AS INT) + 1] ELSE lower(s) END || '-mp' AS form_key,
        count(*) AS days, count(f.title) AS found
    FROM (SELECT cal_date, {_season_case(True)} AS s FROM {_CAL}) x
    LEFT JOIN ({_values([("advent-mp", "A"), ("lent-mp", "L"), ("ordinary-monday-mp", "M")])}) f(k, title)
      ON f.k = CASE WHEN s = 'OrdinaryTime' THEN 'ordinary-' || ['sunday','monday','tuesday','wednesday','thursday','friday','saturday'][CAST(dayofweek(cal_date) AS INT) + 1] ELSE lower(s) END || '-mp'
    GROUP BY 1""")
def computed_key_lookup(spark, d):
    forms = small(spark, [("advent-mp", "A"), ("lent-mp", "L"), ("ordinary-monday-mp", "M")], "form_key string, title string")
    keyed = _seasons(spark, d).withColumn("form_key", calendar.form_key(F.col("form_season"), F.lit("mp"), weekday(F.col("date"))))
    return keyed.join(forms, "form_key", "left").groupBy("form_key").agg(F.count("*").alias("days"), F.count("title").alias("found"))


@query(f"""
    SELECT coalesce(p.season, 'none') AS season, CAST(coalesce(floor(date_diff('day', p.s, CAST(o_orderdate AS DATE)) / 7.0), 0) AS BIGINT) AS week, count(*) AS orders
    FROM orders LEFT JOIN {_PERIOD_SQL} p ON CAST(o_orderdate AS DATE) >= p.s AND (p.e IS NULL OR CAST(o_orderdate AS DATE) < p.e) GROUP BY 1, 2""")
def period_week_index(spark, d):
    p = _periods(spark).withColumn("v", F.struct("season", "start"))
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    out = calendar.as_of(o, "day", p, "v")
    return out.groupBy(F.coalesce("v.season", F.lit("none")).alias("season"), week_index(F.col("day"), F.col("v.start")).alias("week")).agg(F.count("*").alias("orders"))


@query("""
    WITH n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1)
    SELECT n.day, n.events, m.events AS next_events FROM n LEFT JOIN n m ON m.day = n.day + 1""")
def next_day_selfjoin(spark, d):
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    return calendar.next_day(n, "day", ["events"])


@query(f"""
    SELECT CAST(x AS DATE) AS cal_date FROM (SELECT unnest(generate_series(min(cal_date), max(cal_date), INTERVAL 1 DAY)) AS x FROM {_CAL}) WHERE CAST(x AS DATE) NOT IN (SELECT cal_date FROM calendar_rows WHERE cal_date IS NOT NULL)""")
def calendar_gaps(spark, d):
    return calendar.missing_dates(_calendar(spark, d), "cal_date")


@query("""
    SELECT o_custkey, max(CASE WHEN n = 1 THEN day END) AS occurrence_1, max(CASE WHEN n = 2 THEN day END) AS occurrence_2
    FROM (SELECT o_custkey, day, row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS n FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)) GROUP BY 1""")
def nth_occurrence(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return calendar.nth_occurrence(o, "o_custkey", "day", 2)


@query("""
    SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = n // 2""")
def middle_pick(spark, d):
    return calendar.middle_pick(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("""
    SELECT event_type, arg_max(day, (n, day)) AS day, max(n) AS events FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def argmax_day(spark, d):
    n = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.max_by("day", F.struct("n", "day")).alias("day"), F.max("n").alias("events"))


# scans and keyed reads


@query(f"""
    SELECT calendar_id, cal_date, row_id FROM (SELECT *, row_number() OVER (PARTITION BY calendar_id, cal_date ORDER BY src_file DESC NULLS LAST, row_id DESC) AS n FROM {_CAL}) WHERE n = 1""")
def keep_last_file(spark, d):
    rows = _calendar(spark, d).select("calendar_id", "cal_date", "src_file", "row_id")
    return readers.keep_last(rows, ["calendar_id", "cal_date"], [F.col("src_file"), F.col("row_id")]).select("calendar_id", "cal_date", "row_id")


@query("""SELECT event_id, event_type, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09'""")
def day_point_read(spark, d):
    days = table(spark, d, "events").withColumn("date", F.to_date("ts")).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return readers.days_on(days, "2024-01-09").select("event_id", "event_type", "value")


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2""")
def json_field_extract(spark, d):
    k = F.from_json("props", "k bigint").getField("k")
    return table(spark, d, "events").groupBy("event_type", F.floor(k / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT form_id, json_extract_string(body, '$.title') AS title, json_extract_string(body, '$.subtitle') AS subtitle FROM (SELECT DISTINCT form_id, body FROM office_forms)""")
def document_titles(spark, d):
    f = table(spark, d, "office_forms").select("form_id", "body").dropDuplicates(["form_id"])
    v = F.from_json("body", "title string, subtitle string")
    return f.select("form_id", v.getField("title").alias("title"), v.getField("subtitle").alias("subtitle"))


@query(ORACLE["keep_last_file"])
def upsert_deliveries(spark, d):
    """Each calendar's last file upserted into what its earlier files left: every row is in one of the two."""
    rows = _calendar(spark, d).select("calendar_id", "cal_date", "src_file", "row_id")
    last = rows.withColumn("new", F.col("src_file").eqNullSafe(F.max("src_file").over(Window.partitionBy("calendar_id"))))
    old, new = (readers.keep_last(x.drop("new"), ["calendar_id", "cal_date"], [F.col("src_file"), F.col("row_id")]) for x in (last.where("NOT new"), last.where("new")))
    return sinks.upsert(old, new, ["calendar_id", "cal_date"]).select("calendar_id", "cal_date", "row_id")


@query(f"SELECT strftime(cal_date, '%Y-%m') AS month, count(*) AS days FROM {_CAL} WHERE strftime(cal_date, '%Y-%m') BETWEEN strftime(DATE '2031-06-15' - 93, '%Y-%m') AND strftime(DATE '2031-06-15' + 93, '%Y-%m') GROUP BY 1")
def retention_window(spark, d):
    rows = _calendar(spark, d).withColumn("month", F.date_format("cal_date", "yyyy-MM"))
    return rows.where(sinks.in_window(F.col("month"), "2031-06-15", 3)).groupBy("month").agg(F.count("*").alias("days"))


@query("""
    WITH now AS (SELECT form AS name, sha256(string_agg(concat_ws('|', coalesce(section, '∅'), coalesce(seq, -1), coalesce(text, '')), chr(10) ORDER BY section, seq, coalesce(text, ''))) AS h FROM form_lines_app GROUP BY 1),
         was AS (SELECT form AS name, sha256(string_agg(concat_ws('|', coalesce(section, '∅'), coalesce(seq, -1), coalesce(text, '')), chr(10) ORDER BY section, seq, coalesce(text, ''))) AS h FROM form_lines_print GROUP BY 1)
    SELECT coalesce(now.name, was.name) AS name, CASE WHEN was.h IS NULL THEN 'new' WHEN now.h IS NULL THEN 'missing' ELSE 'changed' END AS drift
    FROM now FULL JOIN was ON now.name = was.name WHERE now.h IS DISTINCT FROM was.h""")
def manifest_drift(spark, d):
    def hashes(name):
        # the digest of a bag of lines with their places: a count, sums and an XOR, so no form is gathered in one task
        line = [F.coalesce(F.col("section"), F.lit("\u2205")), F.coalesce(F.col("seq"), F.lit(-1)), F.coalesce(F.col("text"), F.lit(""))]
        h, g = F.xxhash64(*line), F.xxhash64(F.lit(1), *line)
        parts = F.concat_ws("-", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.sum(g.cast("decimal(38,0)")).cast("string"))
        return table(spark, d, name).groupBy(F.col("form").alias("name")).agg(F.sha2(parts, 256).alias("sha256"))

    return sinks.manifest_drift(hashes("form_lines_app"), hashes("form_lines_print"))


# text and grammars

_STRIPPED = r"regexp_replace(coalesce({0}, ''), '^[\s\x0B\p{{Z}}\x{{FEFF}}]+|[\s\x0B\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


@query(f"""
    SELECT row_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(name, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&'), '[\\s\\p{{Z}}\\x85]+', ' ', 'g')) AS name
    FROM {_CAL} WHERE name IS NOT NULL""")
def clean_names(spark, d):
    return _calendar(spark, d).where("name IS NOT NULL").select("row_id", text.clean_inline(F.col("name")).alias("name"))


@query("""SELECT doc_id, trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]) AS line, length(text) AS chars FROM documents WHERE trim(replace(text, chr(10), '')) <> ''""")
def first_line_parts(spark, d):
    docs = table(spark, d, "documents").where(F.trim(F.replace("text", F.lit("\n"), F.lit(""))) != "")
    return docs.select("doc_id", text.first_line(F.col("text")).alias("line"), F.length("text").cast("bigint").alias("chars"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents WHERE text IS NOT NULL""")
def line_explode(spark, d):
    split = text.lines(F.col("text"))
    sizes = F.transform(split, lambda x: F.length(x).cast("bigint"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(split).cast("bigint").alias("lines"), F.array_max(sizes).alias("longest"))


_PARTED = r"(?i)<br\s*/?>|[\n\r\t|;]"


def _parts(c):
    return F.filter(F.transform(F.split(c, _PARTED), lambda x: F.trim(x)), lambda x: x != "")


def _unnest(cols: str, array: str, source: str) -> str:
    """SQL: the members of an array with their places from 0."""
    return f"(SELECT {cols}, u.i AS ord, u.x AS x FROM (SELECT {cols}, unnest(list_transform(generate_series(1, len(a)), lambda i: {{'i': CAST(i - 1 AS INT), 'x': a[i]}})) AS u FROM (SELECT {cols}, {array} AS a FROM {source})))"


_NAME_PARTS = _unnest("row_id", rf"list_filter(list_transform(string_split_regex(name, '{_PARTED}'), lambda x: trim(x)), lambda x: x <> '')", f"{_CAL} WHERE name IS NOT NULL")


@query(rf"""
    WITH n AS (SELECT row_id, ord, x AS line FROM {_NAME_PARTS}),
         c AS (SELECT row_id, ord, line, regexp_extract(line, '\(([^()]*)\)[^()]*$', 1) AS colour, trim(regexp_extract(CASE WHEN regexp_matches(line, '\([^()]*\)[^()]*$') THEN rtrim(regexp_extract(line, '^(.*)\([^()]*\)[^()]*$', 1)) || regexp_extract(line, '\([^()]*\)([^()]*)$', 1) ELSE line END, '^([^\[]*)', 1)) AS body FROM n)
    SELECT row_id, ord, trim(regexp_replace(body, ' - (?:PF|HD|Mem|Com)$', '')) AS name,
        CASE WHEN body LIKE '% - PF' THEN 'principal_feast' WHEN body LIKE '% - HD' THEN 'holy_day' WHEN body LIKE '% - Mem' THEN 'memorial' WHEN body LIKE '% - Com' THEN 'commemoration' WHEN lower(body) LIKE '%sunday%' THEN 'holy_day' ELSE 'feria' END AS rank,
        nullif(colour, '') AS colour FROM c""")
def name_rank_colour(spark, d):
    """Every part of every name."""
    parts = _calendar(spark, d).where("name IS NOT NULL").select("row_id", F.posexplode(_parts(F.col("name"))).alias("ord", "line"))
    return parts.select("row_id", "ord", grammar.name_meta(F.col("line")).alias("m")).select("row_id", "ord", "m.*")


_OFFICES_SQL = f"(SELECT row_id, 'mp' AS office, morning AS raw FROM {_CAL} WHERE morning IS NOT NULL UNION ALL SELECT row_id, 'ep', evening FROM {_CAL} WHERE evening IS NOT NULL)"


def _offices(spark, d):
    """``row_id, office, raw``: both fields of every calendar row."""
    pair = F.array(F.struct(F.lit("mp").alias("office"), F.col("morning").alias("raw")), F.struct(F.lit("ep").alias("office"), F.col("evening").alias("raw")))
    return _calendar(spark, d).select("row_id", F.inline(pair)).where("raw IS NOT NULL")


_RUNS_SQL = _unnest("row_id, office", "regexp_extract_all(raw, 'Ps ([0-9][0-9:, ()-]*)', 1)", _OFFICES_SQL)


@query(rf"""
    WITH f AS (SELECT row_id, office, ord AS run, x AS body FROM {_RUNS_SQL}),
         t AS (SELECT row_id, office, run, unnest(list_transform(generate_series(1, len(string_split(body, ', '))), lambda i: {{'i': i, 't': trim(string_split(body, ', ')[i])}})) AS x FROM f),
         u AS (SELECT row_id, office, run, x.i AS ord, x.t AS raw, regexp_matches(x.t, '^\(.*\)$') AS optional, regexp_replace(x.t, '^\(|\)$', '', 'g') AS c FROM t WHERE x.t <> ''),
         v AS (SELECT *, last_value(CASE WHEN c LIKE '%:%' THEN TRY_CAST(nullif(regexp_extract(c, '^(\d+):', 1), '') AS INT) END IGNORE NULLS) OVER (PARTITION BY row_id, office, run ORDER BY ord) AS cur,
                last_value(CASE WHEN c LIKE '%:%' THEN TRY_CAST(nullif(regexp_extract(c, '^(\d+):', 1), '') AS INT) END IGNORE NULLS) OVER (PARTITION BY row_id, office, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
         w AS (SELECT *, c NOT LIKE '%:%' AND before IS NOT NULL AND (c LIKE '%-%' OR optional) AND regexp_matches(c, '^\d+(?:-\d+)?$') AS goes_on FROM v)
    SELECT row_id, office, run, CAST(row_number() OVER (PARTITION BY row_id, office, run ORDER BY ord) - 1 AS INT) AS ord,
        CASE WHEN c LIKE '%:%' THEN TRY_CAST(nullif(regexp_extract(c, '^(\d+):', 1), '') AS INT) WHEN goes_on THEN before ELSE TRY_CAST(nullif(regexp_extract(c, '^(\d+)', 1), '') AS INT) END AS num,
        CASE WHEN c LIKE '%:%' THEN TRY_CAST(nullif(regexp_extract(regexp_replace(c, '^\d+:', ''), '^(\d+)', 1), '') AS INT) WHEN goes_on THEN TRY_CAST(regexp_extract(c, '^(\d+)', 1) AS INT) END AS first,
        CASE WHEN c LIKE '%:%' THEN coalesce(TRY_CAST(nullif(regexp_extract(c, '-(\d+)$', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(regexp_replace(c, '^\d+:', ''), '^(\d+)', 1), '') AS INT)) WHEN goes_on THEN coalesce(TRY_CAST(nullif(regexp_extract(c, '-(\d+)$', 1), '') AS INT), TRY_CAST(regexp_extract(c, '^(\d+)', 1) AS INT)) END AS last,
        optional FROM w""")
def psalm_entries(spark, d):
    """Every run of psalms in both fields of every row."""
    runs_ = F.regexp_extract_all("raw", F.lit(r"Ps ([0-9][0-9:, ()-]*)"), F.lit(1))
    runs_ = _offices(spark, d).select("row_id", "office", F.posexplode(runs_).alias("run", "body"))
    return runs_.select("row_id", "office", "run", F.posexplode(grammar.psalm_entries(F.col("body"))).alias("ord", "e")).select("row_id", "office", "run", "ord", "e.*")


_CITE = r"(?:[1-4] )?[A-Z][a-z]+ \d+:\d[0-9:,— -]*"
_CITES_SQL = _unnest("row_id, office", f"list_filter(regexp_extract_all(raw, '{_CITE}'), lambda x: NOT starts_with(x, 'Ps '))", _OFFICES_SQL)


@query(rf"""
    WITH c AS (SELECT row_id, office, ord AS cite, trim(regexp_extract(x, '^((?:[1-4] )?[^0-9:]+)', 1)) AS book, trim(regexp_extract(x, '^(?:[1-4] )?[^0-9:]+(.*)$', 1)) AS rest FROM {_CITES_SQL}),
         p AS (SELECT row_id, office, cite, book, unnest(list_transform(generate_series(1, len(string_split(rest, ','))), lambda k: {{'k': k, 't': trim(string_split(rest, ',')[k])}})) AS s FROM c),
         l AS (SELECT row_id, office, cite, book, s.k AS k, regexp_extract(s.t, '^([^—]*)', 1) AS l, regexp_extract(s.t, '—\s*(.*)$', 1) AS r FROM p),
         m AS (SELECT *, TRY_CAST(nullif(regexp_extract(l, '^\s*(\d+)\s*:', 1), '') AS INT) AS lch, regexp_replace(l, '^\s*\d+\s*:', '') AS span, TRY_CAST(nullif(regexp_extract(r, '^(\d+)\s*:', 1), '') AS INT) AS rch FROM l),
         n AS (SELECT *, TRY_CAST(nullif(regexp_extract(span, '^\s*(\d+)', 1), '') AS INT) AS v, TRY_CAST(nullif(regexp_extract(span, '-\s*(\d+)', 1), '') AS INT) AS z,
                coalesce(TRY_CAST(nullif(regexp_extract(r, ':\s*(\d+)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(r, '^(\d+)', 1), '') AS INT)) AS rv FROM m),
         o AS (SELECT *, v IS NOT NULL AND (r = '' OR rv IS NOT NULL) AS fine FROM n),
         q AS (SELECT *, coalesce(lch, last_value(CASE WHEN fine AND r <> '' THEN coalesce(rch, lch) ELSE lch END IGNORE NULLS) OVER (PARTITION BY row_id, office, cite ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS ch FROM o)
    SELECT row_id, office, cite, book, ch AS start_ch, v AS start_v, CASE WHEN r <> '' THEN coalesce(rch, ch) ELSE ch END AS end_ch, CASE WHEN r <> '' THEN rv ELSE coalesce(z, v) END AS end_v FROM q WHERE fine AND ch IS NOT NULL""")
def verse_ranges(spark, d):
    """Every citation of both fields of every row, of any shape."""
    cites = F.filter(F.regexp_extract_all("raw", F.lit(_CITE), F.lit(0)), lambda x: ~x.startswith("Ps "))
    c = _offices(spark, d).select("row_id", "office", F.posexplode(cites).alias("cite", "x")).select("row_id", "office", "cite", grammar.citation(F.col("x")).alias("c"))
    return c.select("row_id", "office", "cite", F.col("c.book").alias("book"), F.inline(grammar.verse_ranges(F.col("c.rest"))))


@query(rf"""
    WITH o AS (SELECT row_id, office, {_STRIPPED.format(r"replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', chr(160)), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&')")} AS t FROM {_OFFICES_SQL})
    SELECT row_id, office, CAST(1 + len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^Or[ \t\r\f\x0B]*$'))) AS INT) AS branches FROM o""")
def branch_lines(spark, d):
    """How many branches each office has: its primary one and those after a line that is only ``Or``."""
    return _offices(spark, d).select("row_id", "office", F.size(grammar.office_branches(F.col("raw"))).alias("branches"))


_REF = r"Coll ([0-9][0-9/]*(?: \(Com: \d+\))?)"
_REFS_SQL = _unnest("row_id, office", f"regexp_extract_all(raw, '{_REF}', 1)", _OFFICES_SQL)


@query(rf"""
    SELECT row_id, office, ord, coalesce(nullif(regexp_extract(x, '^(\d+)', 1), ''), 'none') AS page, nullif(regexp_extract(x, '/(\d+)', 1), '') AS facing, nullif(regexp_extract(x, 'Com: (\d+)', 1), '') AS commemoration FROM {_REFS_SQL}""")
def collect_references(spark, d):
    """Every collect reference of both fields of every row."""
    refs = F.regexp_extract_all("raw", F.lit(_REF), F.lit(1))
    rows = _offices(spark, d).select("row_id", "office", F.posexplode(refs).alias("ord", "c"))
    com = F.try_element_at(F.flatten(grammar.commemoration_pages(F.col("c")).getField("pages")), F.lit(1))
    facing = F.nullif(F.regexp_extract("c", r"/(\d+)", 1), F.lit(""))
    return rows.select("row_id", "office", "ord", F.coalesce(grammar.collect_page(F.col("c")), F.lit("none")).alias("page"), facing.alias("facing"), com.alias("commemoration"))


@query(rf"""
    SELECT row_id, regexp_extract(e, 'Collect of the Day:\s*(.*?)\s*Amen\.?', 1) || ' Amen.' AS collect
    FROM (SELECT row_id, trim(regexp_replace(eucharist, '[\s\p{{Z}}\x85]+', ' ', 'g')) AS e FROM {_CAL} WHERE eucharist LIKE '%Collect of the Day:%Amen%')""")
def inline_collects(spark, d):
    rows = _calendar(spark, d).where(F.col("eucharist").like("%Collect of the Day:%Amen%"))
    return rows.select("row_id", grammar.inline_collect(F.col("eucharist")).alias("collect"))


@query(rf"""
    WITH n AS (SELECT row_id, unnest(list_filter(list_transform(string_split_regex(extra, '(?i)<br\s*/?>'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM {_CAL} WHERE extra IS NOT NULL)
    SELECT row_id, coalesce(nullif(regexp_extract(s, '^\[([a-z]+)\]', 1), ''), 'pastoral') AS type, count(*) AS notes FROM n GROUP BY 1, 2""")
def note_types(spark, d):
    rows = _calendar(spark, d).where("extra IS NOT NULL").select("row_id", F.explode(grammar.notes(F.col("extra"))).alias("n"))
    return rows.groupBy("row_id", F.col("n.type").alias("type")).agg(F.count("*").alias("notes"))


_QUALITY = {"missing_space": r"[a-z][A-Z]", "long_token": r"[a-z]{30,}", "hanging_hyphen": r"[a-z]-\s+[a-z]", "garbled": r"[a-z]{14,}"}


@query(
    rf"SELECT kind, count(*) AS segments, count(*) FILTER (regexp_matches(regexp_replace(text, '\b(?:Mc|Mac)([A-Z])', '\1', 'g'), '[a-z][A-Z]')) AS missing_space, "
    + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}" for n, p in list(_QUALITY.items())[1:])
    + rf""", count(*) FILTER (len(list_filter(generate_series(1, len(w) - 1), lambda i: regexp_extract(w[i], '(?:^|[^\p{{L}}\p{{N}}_])([a-z]+)$', 1) <> '' AND
        regexp_extract(w[i], '(?:^|[^\p{{L}}\p{{N}}_])([a-z]+)$', 1) = regexp_extract(w[i + 1], '^([a-z]+)(?:[^\p{{L}}\p{{N}}_]|$)', 1))) > 0) AS duplicate_word FROM (SELECT *, string_split_regex(lower(text), '[\s\x0B]+') AS w FROM {_SEG}) WHERE text IS NOT NULL GROUP BY 1"""
)
def text_quality_scan(spark, d):
    t = F.col("text")
    tests = [text.missing_space(t), text.long_token(t), text.hanging_hyphen(t), text.garbled(t)]
    return _segments(spark, d).where("text IS NOT NULL").groupBy("kind").agg(F.count("*").alias("segments"), *[F.count_if(x).alias(n) for n, x in zip(_QUALITY, tests)], F.count_if(text.duplicate_word(t)).alias("duplicate_word"))


@query(rf"""
    WITH l AS (SELECT seg_id, unnest(string_split(text, chr(10))[:-2]) AS line FROM {_SEG} WHERE text LIKE '%' || chr(10) || '%')
    SELECT seg_id, count(*) AS wraps FROM l WHERE trim(line) <> '' AND NOT regexp_matches(line, '[,;:.!?—’”)]\s*$') GROUP BY 1""")
def prose_wraps(spark, d):
    rows = _segments(spark, d).where(F.col("text").contains("\n"))
    return rows.select("seg_id", F.explode(text.wrapped_lines(F.col("text"))).alias("line")).groupBy("seg_id").agg(F.count("*").alias("wraps"))


@query(rf"SELECT seg_id, left(sha256(trim(regexp_replace(nfc_normalize(text), '[\s\p{{Z}}\x85]+', ' ', 'g'))), 10) AS line FROM {_SEG} WHERE text IS NOT NULL")
def line_ids(spark, d):
    return _segments(spark, d).where("text IS NOT NULL").select("seg_id", text.line_id(F.col("text")).alias("line"))


@query(f"SELECT seg_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM {_SEG} WHERE text IS NOT NULL")
def html_escape(spark, d):
    return _segments(spark, d).where("text IS NOT NULL").select("seg_id", text.escape_html(F.col("text")).alias("html"))


@query(rf"""
    SELECT seg_id, CASE WHEN length(text) <= 100 THEN text WHEN strpos(substr(text, 1, 81), ' ') = 0 THEN substr(text, 1, 80) ELSE rtrim(regexp_extract(substr(text, 1, 81), '(?s)^(.*) ', 1), ' ') END AS cut FROM {_SEG} WHERE text IS NOT NULL""")
def read_more(spark, d):
    return _segments(spark, d).where("text IS NOT NULL").select("seg_id", text.read_more_cut(F.col("text")).alias("cut"))


@query(rf"""
    WITH v AS (SELECT psalter, psalm, page_no, seq, line_id, text, type, sum(CASE WHEN regexp_matches(text, '^\d+\s{{1,2}}') THEN 1 ELSE 0 END) OVER (PARTITION BY psalter, psalm, page_no ORDER BY seq, line_id) AS verse FROM {_PSA} WHERE type <> 'head' AND text IS NOT NULL)
    SELECT psalter, psalm, page_no, CAST(verse AS BIGINT) AS verse, string_agg(text, ' ' ORDER BY seq, line_id) AS text FROM v GROUP BY 1, 2, 3, 4""")
def psalm_verses(spark, d):
    lines = _psalter(spark, d).where("type <> 'head' AND text IS NOT NULL")
    w = Window.partitionBy("psalter", "psalm", "page_no").orderBy("seq", "line_id")
    v = lines.withColumn("verse", F.sum(F.col("text").rlike(r"^\d+\s{1,2}").cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line_id", "text"))), lambda x: x["text"]), " ")
    return v.groupBy("psalter", "psalm", "page_no", "verse").agg(joined.alias("text"))


_HEX = [("#ffffff", "#000000"), ("#7b1e1e", "#fdf6e3"), ("#00563f", "#eeeeee"), ("#c9a227", "#ffffff"), ("#5b2c6f", "#d7bde2")]


def _lum(c: str) -> str:
    part = lambda i: f"(CAST('0x' || substr({c}, {i}, 2) AS INT) / 255.0)"
    lin = lambda x: f"(CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END)"
    return f"({lin(part(2))} * 0.2126 + {lin(part(4))} * 0.7152 + {lin(part(6))} * 0.0722)"


@query(f"SELECT a, b, round((greatest({_lum('a')}, {_lum('b')}) + 0.05) / (least({_lum('a')}, {_lum('b')}) + 0.05), 3) AS contrast FROM ({_values(_HEX)}) t(a, b)")
def contrast_math(spark, d):
    return small(spark, _HEX, "a string, b string").select("a", "b", F.round(colour.contrast(F.col("a"), F.col("b")), 3).alias("contrast"))


_COLOUR = r"\(([A-Z][a-z]+(?:/[A-Z][a-z]+)?)\)"


@query(f"SELECT row_id, ord, len(list_distinct(string_split(x, '/'))) AS colours FROM {_unnest('row_id', f"regexp_extract_all(name, '{_COLOUR}', 1)", f'{_CAL} WHERE name IS NOT NULL')}")
def colour_lists(spark, d):
    """Every colour mark of every name."""
    rows = _calendar(spark, d).where("name IS NOT NULL").select("row_id", F.posexplode(F.regexp_extract_all("name", F.lit(_COLOUR), F.lit(1))).alias("ord", "c"))
    return rows.select("row_id", "ord", F.size(colour.colour_names(F.replace("c", F.lit("/"), F.lit(" or ")))).cast("bigint").alias("colours"))


# lookups

_PHRASES = [("gate", "g"), ("quiet gate", "qg"), ("sheaf", "s"), ("first sheaf", "fs"), ("embers", "e"), ("nine bells", "nb"), ("kept door", "kd")]


@query(f"""
    WITH h AS (SELECT row_id, tag, row_number() OVER (PARTITION BY row_id ORDER BY length(p) DESC, p) AS n FROM {_CAL} JOIN ({_values(_PHRASES)}) t(p, tag) ON contains(lower(name), p))
    SELECT c.row_id, h.tag FROM {_CAL} c LEFT JOIN h ON h.row_id = c.row_id AND h.n = 1""")
def phrase_longest_match(spark, d):
    phrases = small(spark, _PHRASES, "phrase string, tag string")
    return lookup.longest_phrase(_calendar(spark, d), "name", phrases, "phrase", "tag").select("row_id", "tag")


_KEYS = ["red", "red widget", "bolt", "Blue", "large brown ring x", "small ring", "ring"]


@query(f"""
    WITH k AS (SELECT k FROM ({_values([(x,) for x in _KEYS])}) t(k)), n AS (SELECT DISTINCT p_name AS n FROM part),
         h AS (SELECT n, k, CASE WHEN lower(n) = lower(k) THEN 1 WHEN regexp_matches(lower(n), '(^|[^\\p{{L}}])' || lower(k) || '([^\\p{{L}}]|$)') THEN 2 WHEN contains(lower(k), lower(n)) THEN 3 END AS tier FROM n, k),
         r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY tier, CASE WHEN tier = 2 THEN strpos(lower(n), lower(k)) ELSE 0 END, CASE WHEN tier = 2 THEN -length(k) ELSE length(k) END, k) AS i FROM h WHERE tier IS NOT NULL)
    SELECT p_partkey, k AS known_as, tier FROM part JOIN r ON p_name = n AND i = 1""")
def ranked_contains_join(spark, d):
    keys = small(spark, [(x,) for x in _KEYS], "known_as string")
    part = table(spark, d, "part")
    best = lookup.ranked_contains(part, "p_name", keys, "known_as")
    return part.join(best, "p_name").select("p_partkey", "known_as", "tier")


@query("""
    WITH s AS (SELECT event_id, user_id, CAST(epoch_us(ts) AS BIGINT) AS a, CAST(epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS BIGINT) AS b FROM events),
         r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
    SELECT user_id, count(*) AS islands FROM r WHERE reach IS NULL OR a >= reach GROUP BY 1""")
def overlap_islands(spark, d):
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    s = table(spark, d, "events").select("event_id", "user_id", a.alias("a"), (a + F.round(F.col("value") * 60000000).cast("bigint")).alias("b"))
    return lookup.overlap_islands(s, ["user_id"], "a", "b", ["event_id"]).groupBy("user_id").agg(F.count("*").alias("islands"))


@query(f"""
    WITH r AS (SELECT psalter, min(page_no) AS c1, 2 AS v1, min(page_no) + 40 AS c2, 3 AS v2 FROM {_PSA} GROUP BY 1)
    SELECT l.line_id FROM r JOIN {_PSA} l ON l.psalter = r.psalter WHERE (l.page_no, l.seq) >= (r.c1, r.v1) AND (l.page_no, l.seq) <= (r.c2, r.v2)""")
def verse_range_join(spark, d):
    lines = _psalter(spark, d)
    first = F.min("page_no")
    r = lines.groupBy(F.col("psalter").alias("book")).agg(first.alias("start_ch"), F.lit(2).alias("start_v"), (first + 40).alias("end_ch"), F.lit(3).alias("end_v"))
    verses = lines.select(F.col("psalter").alias("book"), F.col("page_no").alias("ch"), F.col("seq").alias("v"), "line_id")
    return lookup.verses_in_ranges(r, verses).select("line_id")


@query(f"""
    WITH b AS (SELECT DISTINCT psalter, page_no, seq AS a FROM {_PSA} WHERE type = 'head'), i AS (SELECT *, lead(a) OVER (PARTITION BY psalter, page_no ORDER BY a) AS z FROM b)
    SELECT l.line_id, i.a AS first_v FROM {_PSA} l JOIN i ON l.psalter = i.psalter AND l.page_no = i.page_no AND l.seq >= i.a AND (i.z IS NULL OR l.seq < i.z)
    UNION ALL SELECT l.line_id, NULL FROM {_PSA} l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.psalter = l.psalter AND b.page_no = l.page_no)""")
def paragraph_intervals(spark, d):
    lines = _psalter(spark, d).select(F.col("psalter").alias("book"), F.col("page_no").alias("ch"), F.col("seq").alias("v"), "line_id", "type")
    breaks = lines.where("type = 'head'").select("book", "ch", F.col("v").alias("first_v"))
    return lookup.paragraphs(lines.drop("type"), breaks).select("line_id", "first_v")


@query("""
    SELECT d.doc_id, coalesce(m.target_share, f.share) AS share, CASE WHEN m.target_share IS NOT NULL THEN 'first' WHEN f.share IS NOT NULL THEN 'second' ELSE 'none' END AS source
    FROM documents d LEFT JOIN mix_targets m ON m.source = d.source LEFT JOIN (VALUES ('misc', 0.01::DOUBLE), ('office', 0.9::DOUBLE)) f(source, share) ON f.source = d.source""")
def fallback_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("s"))
    first = table(spark, d, "mix_targets").select(F.col("source").alias("s"), F.col("target_share").alias("share"))
    second = small(spark, [("misc", 0.01), ("office", 0.9)], "s string, share double")
    return lookup.fallback(docs, first, second, "s", "share").select("doc_id", "share", "source")


_LABELS = [(1, "red", 0), (1, "small ring", 1), (2, "the Widget", 0), (2, "large blue widget", 1), (3, "nothing", 0)]


@query(f"""
    WITH l AS (SELECT * FROM ({_values(_LABELS)}) t(g, label, pos)), p AS (SELECT p_partkey, p_name, 1 + p_partkey % 3 AS g FROM part),
         h AS (SELECT p_partkey, label, pos, row_number() OVER (PARTITION BY p_partkey ORDER BY pos, label) AS n FROM p JOIN l ON p.g = l.g
               WHERE contains(lower(p_name), regexp_replace(lower(label), '^the ', '')) OR contains(regexp_replace(lower(label), '^the ', ''), lower(p_name)))
    SELECT p_partkey, label, pos FROM h WHERE n = 1""")
def bidirectional_contains(spark, d):
    left = table(spark, d, "part").select("p_partkey", "p_name", (1 + F.col("p_partkey") % 3).alias("g"))
    right = small(spark, _LABELS, "g int, label string, pos int")
    return lookup.containment_either_way(left, right, "g", "p_name", "label", "pos").select("p_partkey", "label", "pos")


# segments


@query(f"""
    WITH RECURSIVE e AS (SELECT DISTINCT section AS key, shared_key AS target FROM segments WHERE form = '_shared'),
        w AS (SELECT DISTINCT form AS root, shared_key AS key FROM segments WHERE form <> '_shared' AND shared_key IS NOT NULL UNION SELECT w.root, e.target FROM w JOIN e ON e.key = w.key WHERE e.target IS NOT NULL)
    SELECT root, w.key, w.key IN (SELECT key FROM e WHERE key IS NOT NULL) AS found FROM w""")
def recursive_deref(spark, d):
    s = table(spark, d, "segments")
    edges = s.where("form = '_shared'").select(F.col("section").alias("key"), F.col("shared_key").alias("target"))
    roots = s.where("form <> '_shared' AND shared_key IS NOT NULL").select(F.col("form").alias("root"), F.col("shared_key").alias("key"))
    return segments.dereference(edges, roots).select("root", "key", "found")


_RUN_SQL = f"""(SELECT *, sum(new) OVER (PARTITION BY form, section ORDER BY seq, path, seg_id) AS run FROM (
    SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY form, section ORDER BY seq, path, seg_id) OR row_number() OVER (PARTITION BY form, section ORDER BY seq, path, seg_id) = 1 THEN 1 ELSE 0 END AS new FROM {_SEG}))"""
_ORDER = ["seq", "path", "seg_id"]


@query(f"SELECT form, section, CAST(run AS BIGINT) AS run, kind, count(*) AS merged, coalesce(string_agg(text, '/' ORDER BY seq, path, seg_id), '') AS text FROM {_RUN_SQL} GROUP BY 1, 2, 3, 4")
def merge_runs(spark, d):
    return segments.merge_runs(_segments(spark, d), ["form", "section"], _ORDER, "kind", "text", "/")


@query()
def merge_segments(spark, d):
    return segments.merge_segments(_segments(spark, d).where("kind NOT IN ('shared', 'alternatives')"), ["form", "section"], _ORDER)


@query(f"""
    WITH g AS (SELECT *, sum(new) OVER w AS run FROM (SELECT *, CASE WHEN group_no IS DISTINCT FROM lag(group_no) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM {_SEG} WINDOW w AS (PARTITION BY form, section ORDER BY seq, path, seg_id)) WINDOW w AS (PARTITION BY form, section ORDER BY seq, path, seg_id)),
         h AS (SELECT *, lag(kind) OVER (PARTITION BY form, section, run ORDER BY seq, path, seg_id) AS p FROM g WHERE kind <> 'rubric'),
         f AS (SELECT *, row_number() OVER (PARTITION BY form, section ORDER BY run, seq, path, seg_id) AS n FROM h WHERE kind = p)
    SELECT form, section, seg_id FROM f WHERE n = 1""")
def role_alternation(spark, d):
    return segments.alternation_breaks(_segments(spark, d), ["form", "section"], _ORDER, "group_no").select("form", "section", "seg_id")


@query(f"SELECT line_id, last_value(title IGNORE NULLS) OVER (PARTITION BY psalter ORDER BY page_no, seq, line_id) AS heading FROM {_PSA}")
def forward_fill(spark, d):
    marker = F.when(F.col("type") == "head", F.col("title"))
    return segments.forward_fill(_psalter(spark, d), ["psalter"], ["page_no", "seq", "line_id"], F.coalesce(marker, F.col("title")), "heading").select("line_id", "heading")


@query(f"""
    WITH a AS (SELECT *, kind = 'rubric' AND length(coalesce(text, '')) > 12 AS m, kind = 'label' AS h FROM {_SEG}),
         b AS (SELECT *, sum(CAST(m AS INT)) OVER (PARTITION BY form, section ORDER BY seq, path, seg_id) AS g FROM a),
         c AS (SELECT *, max(g) OVER (PARTITION BY form, section) AS n, max(CAST(g = 0 AND NOT h AS INT)) OVER (PARTITION BY form, section) AS z FROM b)
    SELECT seg_id FROM c WHERE n = 0 OR (g = 0 AND h) OR g = CASE WHEN z = 1 THEN least(2, n) ELSE least(3, n) END""")
def marker_period_pick(spark, d):
    marker = (F.col("kind") == "rubric") & (F.length(F.coalesce("text", F.lit(""))) > 12)
    return segments.period_pick(_segments(spark, d), ["form", "section"], _ORDER, marker, F.col("kind") == "label", F.lit(2)).select("seg_id")


@query(f"""
    WITH a AS (SELECT *, trim(coalesce(text, '')) = '' AS b, lag(trim(coalesce(text, '')) = '', 1, true) OVER w AS pb, lag(rtrim(text, ' ')) OVER w AS pt,
                 bool_and(trim(coalesce(text, '')) = '') OVER (PARTITION BY psalter, page_no ORDER BY seq, line_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {_PSA} WINDOW w AS (PARTITION BY psalter, page_no ORDER BY seq, line_id))
    SELECT line_id, NOT b AND (coalesce(text LIKE ' %', false) OR coalesce(pt LIKE '%*', false)) AS continued FROM a WHERE NOT (b AND (pb OR rest))""")
def lag_continuation(spark, d):
    out = segments.continuation_lines(_psalter(spark, d), ["psalter", "page_no"], ["seq", "line_id"], "text")
    return out.select("line_id", F.coalesce("continued", F.lit(False)).alias("continued"))


@query(f"""
    SELECT form, section, count(*) AS trailing FROM (SELECT form, section, bool_and(kind = 'rubric') OVER (PARTITION BY form, section ORDER BY seq, path, seg_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM {_SEG}) WHERE t GROUP BY 1, 2""")
def trailing_rubrics(spark, d):
    return segments.trailing_rubrics(_segments(spark, d), ["form", "section"], _ORDER).where("trailing").groupBy("form", "section").agg(F.count("*").alias("trailing"))


@query(f"""
    WITH a AS (SELECT *, max(CAST(kind = 'label' AS INT)) OVER (PARTITION BY form, section ORDER BY seq, path, seg_id) = 1 AS after FROM {_SEG})
    SELECT seg_id, after, CAST(row_number() OVER (PARTITION BY form, section ORDER BY NOT (kind = 'label'), seq, path, seg_id) - 1 AS INT) AS seq FROM a""")
def split_and_reposition(spark, d):
    s = segments.split_at(_segments(spark, d), ["form", "section"], _ORDER, F.col("kind") == "label")
    return segments.reposition(s, ["form", "section"], _ORDER, F.col("kind") == "label").select("seg_id", "after", "seq")


@query(f"""
    WITH s AS (SELECT *, sha256(regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}\\x85]+', ' ', 'g')) AS h FROM {_SEG} WHERE form <> '_shared'),
         f AS (SELECT *, first_value(h) OVER (PARTITION BY section, seq ORDER BY form, seg_id) AS fh, row_number() OVER (PARTITION BY section, seq ORDER BY form, seg_id) AS n FROM s)
    SELECT seg_id FROM f WHERE n > 1 AND h <> fh""")
def shared_block_mismatches(spark, d):
    s = _segments(spark, d).where("form <> '_shared'").withColumn("block", F.concat_ws("#", "section", F.col("seq").cast("string")))
    _, differ = segments.first_copies(s, "block", ["form", "seg_id"], F.coalesce("text", F.lit("")))
    return differ.select("seg_id")


@query(f"""
    WITH b AS (SELECT psalter, min(page_no) AS start FROM {_PSA} GROUP BY 1) SELECT psalter, start, CAST(coalesce(lead(start) OVER (ORDER BY start, psalter) - 1, 999) AS INT) AS "end" FROM b""")
def lead_bounds(spark, d):
    b = _psalter(spark, d).groupBy("psalter").agg(F.min("page_no").alias("start"))
    w = Window.partitionBy(F.lit(0)).orderBy("start", "psalter")  # one row per psalter
    return b.withColumn("end", F.coalesce(F.lead("start").over(w) - 1, F.lit(999)))


# corrections

_FIX = [("c1", "Brand#1", 1, "ring", "band", None), ("c2", "Brand#1", 2, "band", "hoop", None), ("c3", "Brand#7", 3, "widget", "gadget", 2), ("c4", "*", 4, "blue", "azure", None), ("c5", "Brand#99", 5, "x", "y", None), ("c6", "Brand#3", 6, "zzz", "q", None)]


def _fixes(spark: SparkSession) -> DataFrame:
    return small(spark, _FIX, "id string, p_brand string, ord int, old string, new string, count int")


@query("""
    SELECT p_partkey, replace(CASE WHEN p_brand = 'Brand#1' THEN replace(replace(p_name, 'ring', 'band'), 'band', 'hoop') WHEN p_brand = 'Brand#7' THEN replace(p_name, 'widget', 'gadget') ELSE p_name END, 'blue', 'azure') AS p_name FROM part""")
def merge_corrections(spark, d):
    return corrections.apply_replacements(table(spark, d, "part"), _fixes(spark), "p_brand", "p_partkey", "p_name").select("p_partkey", "p_name")


@query(f"""
    WITH c AS (SELECT * FROM ({_values(_FIX)}) t(id, brand, ord, old, new, n)),
         h AS (SELECT id, CAST(sum((length(p_name) - length(replace(p_name, old, ''))) // length(old)) AS BIGINT) AS f FROM c JOIN part ON p_brand = brand OR brand = '*' GROUP BY 1)
    SELECT c.id, CAST(coalesce(n, 1) AS BIGINT) AS wanted, coalesce(f, 0) AS found, CASE WHEN coalesce(f, 0) = 0 THEN 'miss' WHEN f <> coalesce(n, 1) THEN 'count' ELSE 'ok' END AS outcome FROM c LEFT JOIN h ON h.id = c.id""")
def correction_counts(spark, d):
    return corrections.occurrence_check(table(spark, d, "part"), _fixes(spark), "p_brand", "p_name")


@query("""
    SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2) AND n_name IS NOT DISTINCT FROM o THEN w ELSE n_name END AS n_name, CASE WHEN o IS NULL AND w IS NULL THEN 'untouched' WHEN n_name IS NOT DISTINCT FROM o THEN 'applied' ELSE 'stale' END AS outcome
    FROM nation LEFT JOIN (SELECT 1 AS k, (SELECT n_name FROM nation WHERE n_nationkey = 1) AS o, 'renamed' AS w UNION ALL SELECT 2, 'nobody', 'x') c ON c.k = n_nationkey""")
def equality_corrections(spark, d):
    nation = table(spark, d, "nation")
    c = nation.where("n_nationkey = 1").select("n_nationkey", F.col("n_name").alias("old"), F.lit("renamed").alias("new"))
    c = c.unionByName(small(spark, [(2, "nobody", "x")], "n_nationkey int, old string, new string"))
    return corrections.replace_equal(nation, c, ["n_nationkey"], "n_name").select("n_nationkey", "n_name", "outcome")


# audits


@query("""
    WITH l AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1)
    SELECT CASE WHEN o.o_orderkey IS NULL THEN 'no order' WHEN l.k IS NULL THEN 'no lines' WHEN abs(o_totalprice - s) < 0.01 THEN 'ok' WHEN o_totalprice > s THEN 'over' ELSE 'under' END AS outcome, count(*) AS n
    FROM orders o FULL JOIN l ON l.k = o.o_orderkey GROUP BY 1""")
def two_source_compare(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    both = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "full_outer")
    outcome = F.when(F.col("o_totalprice").isNull(), "no order").when(F.col("s").isNull(), "no lines").when(F.abs(F.col("o_totalprice") - F.col("s")) < 0.01, "ok").when(F.col("o_totalprice") > F.col("s"), "over").otherwise("under")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


_ORPHAN_SQL = f"""
    SELECT 'order-customer' AS rule, CAST(k AS VARCHAR) AS id FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL EXCEPT SELECT c_custkey FROM customer)
    UNION ALL SELECT 'line-part', CAST(k AS VARCHAR) FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey IS NOT NULL EXCEPT SELECT p_partkey FROM part)
    UNION ALL SELECT 'shared-section', k FROM (SELECT DISTINCT shared_key AS k FROM segments WHERE shared_key IS NOT NULL EXCEPT SELECT section FROM segments WHERE form = '_shared')"""


def _orphans(spark, d):
    s = table(spark, d, "segments")
    return (
        audit.orphans(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", "order-customer")
        .unionByName(audit.orphans(table(spark, d, "lineitem"), table(spark, d, "part"), "l_partkey", "p_partkey", "line-part"))
        .unionByName(audit.orphans(s, s.where("form = '_shared'"), "shared_key", "section", "shared-section"))
    )


@query(_ORPHAN_SQL)
def integrity_antijoins(spark, d):
    return _orphans(spark, d)


@query(f"""
    WITH f AS ({_ORPHAN_SQL}), w AS (SELECT rule, id FROM f WHERE rule = 'shared-section' AND id < 'd' UNION SELECT 'line-part', '-7')
    SELECT coalesce(f.rule, w.rule) AS rule, coalesce(f.id, w.id) AS id, CASE WHEN f.id IS NOT NULL AND w.id IS NOT NULL THEN 'waived' WHEN f.id IS NOT NULL THEN 'fail' ELSE 'stale' END AS outcome FROM f FULL JOIN w ON f.rule = w.rule AND f.id = w.id""")
def waiver_reconcile(spark, d):
    f = _orphans(spark, d)
    w = f.where("rule = 'shared-section' AND id < 'd'").unionByName(small(spark, [("line-part", "-7")], "rule string, id string"))
    return audit.waivers(f, w, ["rule", "id"])


@query(f"""
    WITH f AS (SELECT section, kind, count(*) AS found FROM {_SEG} WHERE trim(coalesce(text, '')) = 'N' GROUP BY 1, 2), k AS (SELECT section, kind, 1 AS expected FROM f WHERE kind = 'leader' UNION SELECT 'nowhere', 'leader', 3)
    SELECT coalesce(f.section, k.section) AS section, coalesce(f.kind, k.kind) AS kind, coalesce(found, 0) AS found, CAST(coalesce(expected, 0) AS BIGINT) AS expected,
        CASE WHEN expected IS NULL THEN 'new' WHEN coalesce(found, 0) = 0 THEN 'stale' WHEN found <> expected THEN 'count' ELSE 'known' END AS outcome FROM f FULL JOIN k ON f.section = k.section AND f.kind = k.kind""")
def baseline_reconcile(spark, d):
    f = _segments(spark, d).where("trim(coalesce(text, '')) = 'N'").select("section", "kind")
    known = f.where("kind = 'leader'").distinct().withColumn("lines", F.lit(1)).unionByName(small(spark, [("nowhere", "leader", 3)], "section string, kind string, lines int"))
    return audit.baseline(f, known, ["section", "kind"])


_SQ = r"trim(regexp_replace({0}, '[\s\p{{Z}}\x85]+', ' ', 'g'))"


@query(rf"""
    WITH l AS (SELECT form AS unit, text AS line, count(*) AS n FROM form_lines_app WHERE text IS NOT NULL AND form IS NOT NULL GROUP BY 1, 2), r AS (SELECT DISTINCT form AS unit, text AS other FROM form_lines_print WHERE text IS NOT NULL)
    SELECT unit, line, n, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.unit = l.unit AND other = line) THEN 'verbatim'
        WHEN EXISTS (SELECT 1 FROM r WHERE r.unit = l.unit AND {_SQ.format('other')} = {_SQ.format('line')}) THEN 'whitespace'
        WHEN {_SQ.format('line')} <> '' AND EXISTS (SELECT 1 FROM r WHERE r.unit = l.unit AND contains({_SQ.format('other')}, {_SQ.format('line')})) THEN 'part' ELSE 'unaccounted' END AS rule FROM l""")
def conservation_accounting(spark, d):
    return audit.conservation(table(spark, d, "form_lines_app").where("form IS NOT NULL"), table(spark, d, "form_lines_print"), "form", "text")


_CHAIN = conserve.Chain(fix=lambda c: F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), filled=("reading",))
_FIXED = r"trim(regexp_replace(regexp_replace(nfc_normalize({0}), '\s+([,.;:!?])', '\1', 'g'), '[\s\p{{Z}}\x85]+', ' ', 'g'))"
_NSQ = _SQ.replace("{0}", "nfc_normalize({0})")
_NAMED = r"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(trim({0})), '\s*\([^)]*\)\s*$', ''), '^(?:The |An )', ''), '[\s\p{{Z}}\x85]+', ' ', 'g'))"
_PAGE_SQL = rf"""(SELECT *, {_NSQ.format('text')} AS n, {_FIXED.format('text')} AS fixed, {_NAMED.format('text')} AS named FROM (SELECT DISTINCT form AS unit, section, type, seq, text FROM form_lines_print WHERE form IS NOT NULL AND section IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL) WHERE {_NSQ.format('text')} <> '')"""
_SHIP_SQL = "(SELECT DISTINCT form AS unit, section, type, text FROM form_lines_app WHERE form IS NOT NULL AND text IS NOT NULL)"
_REBUILT_SQL = rf"(SELECT DISTINCT unit, {_NSQ.format('text')} AS before, {_NSQ.format("replace(text, 'lantern', 'lamp')")} AS after FROM {_PAGE_SQL})"
_SHIPPED_LINES = rf"(SELECT unit, section, type, {_NSQ.format('line')} AS n FROM (SELECT unit, section, type, unnest(string_split(text, chr(10))) AS line FROM {_SHIP_SQL}) WHERE {_NSQ.format('line')} <> '')"
_SHIPPED_BLOCKS = rf"(SELECT DISTINCT unit, {_NSQ.format("replace(text, chr(10), ' ')")} AS h FROM {_SHIP_SQL})"


def _conserved(spark, d):
    """``page, shipped, rebuilt``: the printed copy is the page, the other what is shipped."""
    known = lambda name, *cols: table(spark, d, name).select(F.col("form").alias("unit"), "section", "type", *cols, "text").where("unit IS NOT NULL AND text IS NOT NULL").distinct()
    page = known("form_lines_print", "seq").where("section IS NOT NULL AND seq IS NOT NULL").withColumn("used_as", F.col("type"))
    before, after = conserve.line_key(F.col("text")), conserve.line_key(F.replace("text", F.lit("lantern"), F.lit("lamp")))
    return page, known("form_lines_app"), page.select("unit", before.alias("before"), after.alias("after")).where("before <> ''").distinct()


@query(rf"""
    WITH p AS MATERIALIZED (SELECT * FROM {_PAGE_SQL}), l AS MATERIALIZED (SELECT DISTINCT unit, type, n FROM {_SHIPPED_LINES}), b AS MATERIALIZED (SELECT * FROM {_SHIPPED_BLOCKS}), r AS (SELECT * FROM {_REBUILT_SQL}),
         g AS MATERIALIZED (SELECT r.* FROM r WHERE before <> after AND EXISTS (SELECT 1 FROM b WHERE b.unit = r.unit AND contains(h, after)))
    SELECT unit, section, seq, text, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.unit = p.unit AND l.n = p.n) THEN 'verbatim' WHEN EXISTS (SELECT 1 FROM b WHERE b.unit = p.unit AND contains(h, p.n)) THEN 'reflowed'
        WHEN EXISTS (SELECT 1 FROM l WHERE l.unit = p.unit AND l.n = p.fixed) OR EXISTS (SELECT 1 FROM b WHERE b.unit = p.unit AND p.fixed <> '' AND contains(h, p.fixed)) THEN 'whitespace'
        WHEN type = 'heading' THEN 'heading' WHEN regexp_matches(n, '(?i)^(?:or|and)\.?$') THEN 'separator' WHEN EXISTS (SELECT 1 FROM l WHERE l.unit = p.unit AND l.type = 'label' AND l.n = p.named) THEN 'label'
        WHEN section = 'reading' AND coalesce(type, '') NOT IN ('label', 'rubric') THEN 'lectionary' WHEN EXISTS (SELECT 1 FROM g WHERE g.unit = p.unit AND contains(before, p.n)) THEN 'corrected' ELSE 'UNACCOUNTED' END AS rule FROM p""")
def conservation_page(spark, d):
    """Every printed line with the rule that accounts for it in what is shipped."""
    page, shipped, rebuilt = _conserved(spark, d)
    return conserve.page_to_data(page, shipped, _CHAIN, rebuilt).select("unit", "section", "seq", "text", "rule")


@query(rf"""
    WITH p AS MATERIALIZED (SELECT * FROM {_PAGE_SQL}), l AS MATERIALIZED (SELECT unit, n, min(struct_pack(section := section, type := type)) AS o FROM {_SHIPPED_LINES} GROUP BY 1, 2),
         s AS MATERIALIZED (SELECT unit, string_agg(n, ' ' ORDER BY seq, section, type NULLS FIRST, n) AS h FROM p GROUP BY 1), r AS MATERIALIZED (SELECT * FROM {_REBUILT_SQL})
    SELECT unit, o.section AS section, o.type AS type, n AS line, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.unit = l.unit AND p.n = l.n) THEN 'printed' WHEN EXISTS (SELECT 1 FROM s WHERE s.unit = l.unit AND contains(h, l.n)) THEN 'printed-joined'
        WHEN EXISTS (SELECT 1 FROM s WHERE s.unit = l.unit AND contains({_FIXED.format('h')}, l.n)) THEN 'whitespace' WHEN o.type = 'label' AND EXISTS (SELECT 1 FROM p WHERE p.unit = l.unit AND p.named = l.n) THEN 'label'
        WHEN o.type = 'label' AND regexp_matches(n, '^(?:I{{1,3}}|IV|V)$') THEN 'structural' WHEN EXISTS (SELECT 1 FROM r WHERE r.unit = l.unit AND contains(after, l.n) AND NOT contains(before, l.n)) THEN 'corrected' ELSE 'UNACCOUNTED' END AS rule FROM l""")
def conservation_data(spark, d):
    """Every shipped line with the rule that accounts for it on the page."""
    page, shipped, rebuilt = _conserved(spark, d)
    return conserve.data_to_page(page, shipped, ["seq", "section", "type"], _CHAIN, rebuilt)


@query(f"""
    WITH x AS (SELECT 'page' AS direction, rule, unit FROM ({ORACLE['conservation_page']}) UNION ALL SELECT 'data', rule, unit FROM ({ORACLE['conservation_data']}))
    SELECT direction, rule, unit, false AS whole, count(*) AS lines FROM x GROUP BY 1, 2, 3 UNION ALL SELECT direction, rule, NULL, true, count(*) FROM x GROUP BY 1, 2""")
def conservation_counters(spark, d):
    """How many lines each rule accounts for, in both directions, by form and in all."""
    return conserve.accounts(conservation_page(spark, d), conservation_data(spark, d))


@query(f"""
    SELECT form, count(*) AS segments, count(*) FILTER (kind = 'leader') AS leaders, count(*) FILTER (kind = 'response') AS responses, count(DISTINCT section) AS sections,
        CAST(coalesce(sum(length(text)) FILTER (kind NOT IN ('rubric', 'label')), 0) AS BIGINT) AS chars, bool_or(section LIKE 'canticle%') AS canticle FROM {_SEG} GROUP BY 1""")
def group_metrics(spark, d):
    kind = F.col("kind")
    chars = F.coalesce(F.sum(F.when(~kind.isin("rubric", "label"), F.length("text"))), F.lit(0)).cast("bigint")
    return _segments(spark, d).groupBy("form").agg(
        F.count("*").alias("segments"), F.count_if(kind == "leader").alias("leaders"), F.count_if(kind == "response").alias("responses"),
        F.count_distinct("section").alias("sections"), chars.alias("chars"), F.bool_or(F.col("section").startswith("canticle")).alias("canticle"),
    )


_METRIC = f"(SELECT form, regexp_extract(form, '_(mp|ep|midday)_', 1) AS peer, CAST(count(*) FILTER (section = 'litany') AS DOUBLE) AS value FROM {_SEG} GROUP BY 1)"


def _metric(spark, d):
    """Litany segments of every form; many forms have none."""
    return _segments(spark, d).groupBy("form").agg(F.count_if(F.col("section") == "litany").cast("double").alias("value")).withColumn("peer", F.regexp_extract("form", "_(mp|ep|midday)_", 1))


@query(f"""
    SELECT form, CASE WHEN value <> 0 THEN round(abs(value - m) / s, 1) END AS z FROM (SELECT *, avg(value) OVER (PARTITION BY peer) AS m, stddev_pop(value) OVER (PARTITION BY peer) AS s, count(*) OVER (PARTITION BY peer) AS n FROM {_METRIC}) WHERE n > 1 AND s > 0 AND ((value = 0 AND m > 0) OR (value <> 0 AND abs(value - m) / s > 2.0))""")
def peer_zscore(spark, d):
    return audit.peer_zscore(_metric(spark, d), ["peer"], "value").select("form", "z")


@query(f"""
    WITH f AS (SELECT form, regexp_extract(form, '^([a-z_]+)_(?:mp|ep|midday)_', 1) AS peer, bool_or(section LIKE 'litany%') AS flag FROM {_SEG} GROUP BY 1),
         c AS (SELECT *, count(*) FILTER (flag) OVER (PARTITION BY peer) AS y, count(*) FILTER (NOT flag) OVER (PARTITION BY peer) AS n FROM f)
    SELECT form, flag FROM c WHERE least(y, n) > 0 AND least(y, n) <= 2 AND flag <> (y > n)""")
def boolean_minority(spark, d):
    f = _segments(spark, d).groupBy("form").agg(F.bool_or(F.col("section").startswith("litany")).alias("flag")).withColumn("peer", F.regexp_extract("form", "^([a-z_]+)_(?:mp|ep|midday)_", 1))
    return audit.boolean_minority(f, ["peer"], "flag").select("form", "flag")


@query(f"SELECT form, text, count(*) AS times FROM {_SEG} WHERE kind = 'rubric' AND text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_rubrics(spark, d):
    return audit.repeats_within(_segments(spark, d).where("kind = 'rubric' AND text IS NOT NULL"), "form", "text")


@query(f"SELECT text, min(form) AS form FROM {_SEG} WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT form) = 1")
def corpus_singletons(spark, d):
    return audit.singletons(_segments(spark, d).where("text IS NOT NULL"), "form", "text")


_RULE_SECTIONS = coherence.Sections(
    hymn="invitatory", collects="collect", verse=coherence.VERSE_SECTIONS, proclamation=("psalmody", "reading", "reading_response", "canticle", "affirmation"), dialogues=("litany", "dismissal"), light=("invitatory", "doxology"),
)
_HYMN_LINES = [("lent_ep", 2), ("advent_ep", 3), ("easter_ep", 2), ("ordinary_ep", 2)]
_SANCTIONED = [("advent", "dismissal", "N"), ("lent", "collect", "Or")]
_TITLES = r"""(SELECT form, CASE split_part(form, '_', 1) WHEN 'ordinary' THEN 'OrdinaryTime' WHEN 'weekday' THEN 'OrdinaryTime' WHEN 'all' THEN 'AllSaints' ELSE upper(left(split_part(form, '_', 1), 1)) || substr(split_part(form, '_', 1), 2) END AS season, regexp_extract(form, '_(mp|ep|midday)_', 1) AS office FROM (SELECT DISTINCT form FROM segments WHERE form <> '_shared'))"""


def _sql_in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_R = _RULE_SECTIONS
_CLOSING_SQL = " OR ".join(f"regexp_matches(replace(t, chr(160), ' '), '{p.replace(chr(39), chr(39) * 2)}'{', ' + repr('i') if 'Lord' in p else ''})" for p in coherence.CLOSING_RUBRICS)
_CANTICLE_SQL = " OR ".join(f"(season = '{k}' AND NOT ({' OR '.join(f'starts_with(canticle, {chr(39)}{x}{chr(39)})' for x in coherence.DAILY_CANTICLES + v)}))" for k, v in coherence.SEASONAL_CANTICLES.items())
_RULE_SQL = rf"""(
    WITH s AS (SELECT *, {_STRIPPED.format('text')} AS t FROM {_SEG} WHERE form <> '_shared'), f AS (SELECT * FROM {_TITLES}),
    o AS (SELECT form, max(nullif(json_extract_string(body, '$.title'), '')) AS title FROM office_forms GROUP BY 1),
    a AS (SELECT form,
        coalesce(bool_or(section = 'dismissal' AND t <> ''), false) AND NOT coalesce(bool_or(section = 'dismissal' AND contains(t, 'Amen')), false) AS r0,
        bool_or(regexp_matches(t, 'Amen \.|[A-Za-z0-9_] \.$')) AS r1, bool_or(kind = 'response' AND length(t) < 3) AS r2,
        NOT (bool_or(section = 'opening_responses' AND kind = 'leader' AND t <> '') AND bool_or(section = 'opening_responses' AND kind = 'response' AND t <> '')) AS r3,
        bool_or(t = 'N') AS r4, bool_or(section IN {_sql_in(_R.proclamation)} AND t <> '') AND NOT bool_or(section = 'canticle' AND kind = 'leader' AND t <> '') AS r5,
        bool_or(section = 'canticle' AND t <> '') AND NOT bool_or(section = 'canticle' AND kind = 'leader' AND contains(t, chr(10))) AS r6,
        bool_or(section = 'intercessions') AND NOT bool_or(section = 'intercessions' AND length(t) > 2 AND t <> 'N') AS r7,
        bool_or(kind IN ('leader', 'response') AND section NOT IN {_sql_in(_R.verse)} AND contains(t, chr(10))) AS r8,
        bool_or(section IN {_sql_in(_R.light)} AND t <> '') AS light, count(*) FILTER (section = 'psalmody') AS psalms, count(*) FILTER (section = 'reading') AS lessons, bool_or(section = 'doxology') AS doxology,
        bool_or(section = 'reading_response') AS answered, count(*) FILTER (section = 'collect') AS collects, count(*) FILTER (section = 'collect' AND kind = 'leader') AS items,
        arg_min(text, (seq, path, seg_id)) FILTER (section = 'canticle' AND kind = 'label' AND text IS NOT NULL) AS canticle FROM s GROUP BY 1),
    d AS (SELECT a.*, f.season, f.office, o.title FROM a JOIN f ON a.form = f.form LEFT JOIN o ON o.form = a.form),
    g AS (SELECT *, sum(new) OVER w AS run FROM (SELECT *, CASE WHEN group_no IS DISTINCT FROM lag(group_no) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM s WHERE section IN {_sql_in(_R.dialogues)} WINDOW w AS (PARTITION BY form, section ORDER BY seq, path, seg_id)) WINDOW w AS (PARTITION BY form, section ORDER BY seq, path, seg_id)),
    h AS (SELECT form, kind, lag(kind) OVER (PARTITION BY form, section, run ORDER BY seq, path, seg_id) AS p FROM g WHERE kind <> 'rubric'),
    y AS (SELECT form, arg_min(coalesce(text, ''), (seq, path, seg_id)) AS t FROM s WHERE section = 'invitatory' AND kind = 'leader' GROUP BY 1),
    z AS (SELECT form, arg_max(kind, (seq, path, seg_id)) AS kind, arg_max(t, (seq, path, seg_id)) AS t FROM s WHERE t <> '' GROUP BY form, section),
    l AS (SELECT form, section, {_STRIPPED.format('x')} AS line FROM (SELECT form, section, unnest(string_split(t, chr(10))[:-2]) AS x FROM s WHERE section IN ('collect', 'dismissal') AND kind IN ('leader', 'response')))
    SELECT form, rule, tier FROM (
        SELECT form, 'dismissal-has-amen' AS rule, 1 AS tier, r0 AS x FROM a UNION ALL SELECT form, 'no-stray-space-before-period', 1, r1 FROM a UNION ALL SELECT form, 'non-empty-responses', 1, r2 FROM a
        UNION ALL SELECT form, 'opening-has-leader-and-response', 1, r3 FROM a UNION ALL SELECT form, 'no-empty-segments', 1, r4 FROM a UNION ALL SELECT form, 'canticle-has-verse-content', 1, r5 FROM d
        UNION ALL SELECT form, 'canticle-has-verse-breaks', 2, r6 FROM d UNION ALL SELECT form, 'intercessions-nonempty', 2, r7 FROM d UNION ALL SELECT form, 'no-prose-line-breaks', 2, r8 FROM a
        UNION ALL SELECT DISTINCT form, 'leader-response-alternation', 1, true FROM h WHERE kind = p
        UNION ALL SELECT y.form, 'phos-hilaron-line-count', 2, len(string_split(t, chr(10))) < least FROM y JOIN ({_values(_HYMN_LINES)}) m(who, least) ON starts_with(y.form, m.who)
        UNION ALL SELECT form, 'seasonal-title-coherence', 2, season <> 'OrdinaryTime' AND title IS NULL FROM d
        UNION ALL SELECT DISTINCT form, 'no-orphan-rubrics', 2, true FROM z WHERE kind = 'rubric' AND NOT ({_CLOSING_SQL})
        UNION ALL SELECT form, 'evening-has-light', 1, office = 'ep' AND NOT light FROM d UNION ALL SELECT form, 'psalter-gloria-present', 1, psalms > 0 AND NOT doxology FROM d
        UNION ALL SELECT form, 'reading-response-present', 1, lessons > 0 AND NOT answered FROM d UNION ALL SELECT form, 'collect-resolvable', 1, collects = 0 FROM d
        UNION ALL SELECT form, 'collect-week-in-range', 3, season <> 'OrdinaryTime' AND collects > 0 AND items = 0 FROM d
        UNION ALL SELECT form, 'seasonal-canticle-coherence', 3, canticle IS NOT NULL AND ({_CANTICLE_SQL}) FROM d
        UNION ALL SELECT DISTINCT form, 'collect-and-dismissal-no-orphan-breaks', 2, true FROM l WHERE line <> '' AND NOT regexp_matches(line, '[.,;:!?]\s*$')
            AND NOT EXISTS (SELECT 1 FROM ({_values(_SANCTIONED)}) q(who, part, said) WHERE starts_with(l.form, who) AND part = l.section AND said = l.line)) WHERE x)"""


def _form_facts(spark, d, held):
    """What a bound day would appoint, read off the form: season and office by its name, the rest from its sections."""
    first, hour = F.split("form", "_")[0], F.regexp_extract("form", "_(mp|ep|midday)_", 1)
    season = F.when(first.isin("ordinary", "weekday"), "OrdinaryTime").when(first == "all", "AllSaints").otherwise(F.concat(F.upper(F.substring(first, 1, 1)), F.substr(first, F.lit(2))))
    here = lambda name: F.count_if(F.col("section") == name)
    label = (F.col("section") == "canticle") & (F.col("kind") == "label") & F.col("text").isNotNull()
    facts = held.groupBy("form").agg(
        here("psalmody").alias("psalms"), here("reading").alias("lessons"), (here("doxology") > 0).alias("doxology"), (here("reading_response") > 0).alias("lesson_response"), here("collect").alias("collects"),
        F.min_by("text", F.when(label, F.struct(*_ORDER))).alias("canticle"), F.count_if((F.col("section") == "collect") & (F.col("kind") == "leader")).alias("items"),
    )
    title = F.get_json_object("body", "$.title")
    titles = table(spark, d, "office_forms").groupBy("form").agg(F.max(F.when(title != "", title)).alias("title"))
    facts = facts.join(titles, "form", "left").withColumn("season", season).withColumn("office", hour)
    return facts.withColumn("week_items", F.when(F.col("collects") > 0, F.col("items")))


def _by_prefix(facts, rows, schema):
    given = small(facts.sparkSession, rows, "who string, " + schema)
    return facts.select("form").join(F.broadcast(given), F.col("form").startswith(F.col("who"))).drop("who")


def _rules(spark, d):
    # repeated rows are dropped once for all rules
    held = written(_segments(spark, d).where("form <> '_shared'").select("seg_id", "form", "section", "seq", "path", "group_no", "kind", "text"))
    facts, s = checkpoint(_form_facts(spark, d, held)), held
    fixed = coherence.static_findings(s, facts.select("form", "season", "title"), _by_prefix(facts, _HYMN_LINES, "least int"), _RULE_SECTIONS)
    return fixed.unionByName(coherence.dynamic_findings(s, facts, _by_prefix(facts, _SANCTIONED, "section string, line string"), _RULE_SECTIONS))


@query(f"SELECT * FROM {_RULE_SQL}")
def coherence_rules(spark, d):
    """All twenty rules over every form."""
    return _rules(spark, d)


_EXEMPT = [("litany_segments", 5), ("litany", 3)]
_OUTLIER_SQL = "(SELECT form, 'litany_segments' AS metric, z, false AS flag FROM ({z}) UNION ALL SELECT form, 'litany', NULL, true FROM ({b}))"


@query(f"""
    WITH x AS (SELECT form, CASE tier WHEN 1 THEN 10 WHEN 2 THEN 3 ELSE 5 END AS cost FROM {_RULE_SQL} r
        UNION ALL SELECT form, CASE WHEN EXISTS (SELECT 1 FROM ({_values(_EXEMPT)}) e(m, n) WHERE m = metric AND length(form) % n = 0) THEN 0 WHEN z >= 3.0 AND NOT flag THEN 15 ELSE 5 END FROM {_OUTLIER_SQL.format(z=ORACLE['peer_zscore'], b=ORACLE['boolean_minority'])}
        UNION ALL SELECT DISTINCT form, 100 FROM segments WHERE form LIKE '%0000013')
    SELECT form, CAST(greatest(0, 100 - sum(cost)) AS BIGINT) AS score FROM x GROUP BY 1""")
def penalty_score(spark, d):
    """Rules, outliers but for the expected ones, and forms whose day did not resolve (here those numbered 13)."""
    far = peer_zscore(spark, d).select("form", F.lit("litany_segments").alias("metric"), "z", F.lit(False).alias("flag"))
    rare = boolean_minority(spark, d).select("form", F.lit("litany").alias("metric"), F.lit(None).cast("double").alias("z"), F.lit(True).alias("flag"))
    outliers = far.unionByName(rare)
    expected = F.lit(False)
    for metric, n in _EXEMPT:
        expected = expected | ((F.col("metric") == metric) & (F.length("form") % n == 0))
    lost = _segments(spark, d).where(F.col("form").endswith("0000013")).select("form").distinct()
    return audit.penalty_scores(_rules(spark, d), outliers, outliers.where(expected), lost)


@query(f"SELECT coalesce(min(score), 100) AS score FROM ({ORACLE['penalty_score']})")
def overall_score(spark, d):
    return audit.overall(penalty_score(spark, d))


@query(f"SELECT rule, tier, CAST(grouping(rule, tier) AS BIGINT) AS level, count(*) AS findings FROM {_RULE_SQL} GROUP BY ROLLUP (rule, tier)")
def rule_rollup(spark, d):
    return _rules(spark, d).rollup("rule", "tier").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("findings"))


@query("""
    SELECT l_returnflag, l_extendedprice AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE r = least(CAST(floor(n * 0.995) AS BIGINT), n - 1)""")
def nearest_rank_quantile(spark, d):
    return audit.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.995)


@query(rf"""
    WITH s AS (SELECT doc_id AS id, sha256({_SQ.format('text')}) AS h FROM documents WHERE text IS NOT NULL), f AS (SELECT h, min(id) AS first_id FROM s GROUP BY 1)
    SELECT id, first_id FROM s JOIN f ON s.h = f.h WHERE id <> first_id""")
def canonical_hash_dedup(spark, d):
    return audit.duplicates(table(spark, d, "documents"), "doc_id", text.squash(F.col("text")))


@query("""
    SELECT s_suppkey, CASE WHEN n = 1 THEN name WHEN detail <> '' THEN name || ', ' || detail ELSE name || ' (' || day || ')' END AS key
    FROM (SELECT s_suppkey, 'N' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS detail, CAST(s_suppkey AS VARCHAR) AS day, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)""")
def collision_keys(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("detail"), F.col("s_suppkey").cast("string").alias("day"))
    return audit.collision_keys(s, "name", "detail", "day").select("s_suppkey", "key")


@query(f"SELECT form, count(*) AS findings FROM {_RULE_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 5")
def top_n_worst(spark, d):
    return audit.worst(_rules(spark, d).groupBy("form").agg(F.count("*").alias("findings")), "form", "findings")


_T = "concat_ws('|', coalesce(type, ''), coalesce(text, ''))"


@query(f"""
    WITH a AS (SELECT form, section, type, text FROM form_lines_app WHERE form IS NOT NULL AND section IS NOT NULL), b AS (SELECT form, section, type, text FROM form_lines_print WHERE form IS NOT NULL AND section IS NOT NULL),
         x AS (SELECT *, row_number() OVER (PARTITION BY form, section ORDER BY type NULLS FIRST, text NULLS FIRST) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
         y AS (SELECT *, row_number() OVER (PARTITION BY form, section ORDER BY type NULLS FIRST, text NULLS FIRST) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
    SELECT coalesce(x.form, y.form) AS form, coalesce(x.section, y.section) AS section, x.t AS old, y.t AS new, CASE WHEN x.n IS NULL THEN 'added' WHEN y.n IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM (SELECT *, {_T} AS t FROM x) x FULL JOIN (SELECT *, {_T} AS t FROM y) y ON x.form = y.form AND x.section = y.section AND x.n = y.n""")
def multiset_diff(spark, d):
    a, b = (table(spark, d, f"form_lines_{x}").where("form IS NOT NULL AND section IS NOT NULL") for x in ("app", "print"))
    return audit.multiset_diff(a, b, ["form", "section"], ["type", "text"])


@query("""
    WITH a AS (SELECT form, section, list(coalesce(type, '∅') || '|' || coalesce(text, '∅') ORDER BY loaded_at) AS s FROM form_lines_app GROUP BY 1, 2), b AS (SELECT form, section, list(coalesce(type, '∅') || '|' || coalesce(text, '∅') ORDER BY loaded_at) AS s FROM form_lines_print GROUP BY 1, 2)
    SELECT a.form, a.section FROM a JOIN b ON a.form = b.form AND a.section = b.section WHERE list_sort(a.s) = list_sort(b.s) AND a.s <> b.s""")
def moved_sections(spark, d):
    a, b = (table(spark, d, f"form_lines_{x}").where("form IS NOT NULL AND section IS NOT NULL") for x in ("app", "print"))
    return audit.moved(a, b, ["form", "section"], "loaded_at", ["type", "text"])


_REQUIRED = ["canticle", "dismissal", "doxology"]


@query(f"SELECT f.form, r.section FROM (SELECT DISTINCT form FROM segments) f, ({_values([(x,) for x in _REQUIRED])}) r(section) WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.form = f.form AND s.section = r.section)")
def required_sections_sweep(spark, d):
    return audit.required_missing(_segments(spark, d), "form", "section", _REQUIRED)


@query(rf"""
    WITH x AS (SELECT row_id, nullif(regexp_extract(coalesce(morning, ''), 'Coll (\d+)', 1), '') AS by_ref, CASE WHEN eucharist LIKE 'Collect of the Day:%' THEN eucharist END AS inline, nullif(src_file, '') AS saint, nullif(regexp_extract(coalesce(evening, ''), 'Coll (\d+)', 1), '') AS seasonal, nullif(extra, '') AS occasional FROM {_CAL}),
         l AS (SELECT row_id, list_filter([CASE WHEN by_ref IS NOT NULL THEN 'reference' WHEN inline IS NOT NULL THEN 'inline' END, CASE WHEN by_ref IS NULL AND inline IS NULL AND saint IS NOT NULL THEN 'saint' END, CASE WHEN seasonal IS NOT NULL THEN 'seasonal' END, CASE WHEN occasional IS NOT NULL THEN 'occasional' END], lambda o: o IS NOT NULL) AS o FROM x)
    SELECT row_id, ord, x AS option FROM {_unnest('row_id', 'o', 'l')}""")
def option_precedence(spark, d):
    """The collects a day may use, in order of precedence; the file's name stands for a saint's."""
    ref = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"Coll (\d+)", 1), F.lit(""))
    inline = F.when(F.col("eucharist").startswith("Collect of the Day:"), F.col("eucharist"))
    days = _calendar(spark, d).select(
        F.col("row_id").alias("date"), ref("morning").alias("by_ref"), inline.alias("inline"), F.nullif("src_file", F.lit("")).alias("saint"), ref("evening").alias("seasonal"), F.nullif("extra", F.lit("")).alias("occasional")
    )
    return form_rules.collect_options(days).select(F.col("date").alias("row_id"), "ord", "option")


_FINDING = """'{{"finding":"{0}","id":"' || row_id || '"}}'"""


@query(f"""
    SELECT {_FINDING.format('empty name')} AS finding FROM {_CAL} WHERE trim(coalesce(name, '')) = '' UNION ALL SELECT {_FINDING.format('no office')} FROM {_CAL} WHERE trim(coalesce(morning, '')) = '' AND trim(coalesce(evening, '')) = ''
    UNION ALL SELECT {_FINDING.format('raw entity')} FROM {_CAL} WHERE regexp_matches(concat_ws(' ', morning, evening), '&[a-z]+;')""")
def gate_findings(spark, d):
    """All that the gate would refuse the calendar for."""
    rows = _calendar(spark, d)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    tests = {"empty name": blank("name"), "no office": blank("morning") & blank("evening"), "raw entity": F.concat_ws(" ", "morning", "evening").rlike(r"&[a-z]+;")}
    return audit.all_findings([rows.where(t).select(F.lit(n).alias("finding"), F.col("row_id").cast("string").alias("id")) for n, t in tests.items()])


@query(f"""
    SELECT count(*) AS days, count(*) FILTER (eucharist IS NOT NULL AND eucharist <> '') AS with_eucharist, count(*) FILTER (extra IS NOT NULL AND extra <> '') AS with_notes, min(cal_date) AS first, max(cal_date) AS last FROM {_CAL}""")
def population_counts(spark, d):
    some = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    return _calendar(spark, d).agg(F.count("*").alias("days"), some("eucharist").alias("with_eucharist"), some("extra").alias("with_notes"), F.min("cal_date").alias("first"), F.max("cal_date").alias("last"))


@query("""
    (SELECT form, section, type FROM form_lines_app EXCEPT SELECT form, section, type FROM form_lines_print) UNION ALL (SELECT form, section, type FROM form_lines_print EXCEPT SELECT form, section, type FROM form_lines_app)""")
def section_set_difference(spark, d):
    """Kinds of line that a section of a form has in one of the copies only."""
    a, b = (table(spark, d, f"form_lines_{x}").select("form", "section", "type") for x in ("app", "print"))
    return a.subtract(b).union(b.subtract(a))


# composites


@query(rf"""
    WITH f AS (SELECT * FROM ({ORACLE['psalm_entries']}) WHERE num IS NOT NULL),
         v AS (SELECT DISTINCT CAST(psalm AS INT) AS num, seq AS v FROM {_PSA} WHERE psalter = 'psalter_common' AND type = 'verse' AND regexp_full_match(psalm, '\d+'))
    SELECT row_id, office, run, ord, f.num, count(*) AS verses FROM f JOIN v ON v.num = f.num WHERE f.first IS NULL OR v.v BETWEEN f.first AND f.last GROUP BY 1, 2, 3, 4, 5""")
def appointed_psalms(spark, d):
    """How many verses the common psalter has for every psalm of both fields."""
    v = _psalter(spark, d).where("psalter = 'psalter_common' AND type = 'verse'").select(F.col("psalm").try_cast("int").alias("num"), F.col("seq").alias("v")).where("num IS NOT NULL").distinct()
    # one row a psalm, so that an entry meets one row and not all its verses
    per = v.groupBy("num").agg(F.collect_list("v").alias("vs"))
    verses = F.size(F.filter("vs", lambda x: F.col("first").isNull() | x.between(F.col("first"), F.col("last")))).cast("bigint")
    return psalm_entries(spark, d).join(per, "num").select("row_id", "office", "run", "ord", "num", verses.alias("verses")).where("verses > 0")


def _psalm_entries_of_offices(spark, d):
    """``row_id, office, slot, choice, ord, num, first, last, optional`` of both fields of every calendar row."""
    # a row stands for a day: repeated dates of a calendar are rows of their own here
    days = _calendar(spark, d).select(F.col("row_id").cast("string").alias("calendar_id"), F.col("cal_date").alias("date"), "morning", "evening")
    offices = office.day_offices(days).withColumn("row_id", F.col("calendar_id").cast("bigint"))
    sets = offices.select("row_id", "office", "slot", F.posexplode(grammar.psalm_sets(F.col("psalms"))).alias("choice", "tokens"))
    return sets.select("row_id", "office", "slot", "choice", F.posexplode(grammar.psalm_entries(F.col("tokens"))).alias("ord", "e")).select("row_id", "office", "slot", "choice", "ord", "e.*")


@query()
def psalm_entries_all(spark, d):
    """The psalm entries of both fields of every calendar row, all branches and choices."""
    return _psalm_entries_of_offices(spark, d)


@query()
def name_rank_colour_all(spark, d):
    """Every observance of every name, in order, with its rank and colour."""
    lines_ = grammar.observance_lines(unpacked(F.col("name")))
    return _calendar(spark, d).where("name IS NOT NULL").select("row_id", F.posexplode(lines_).alias("ord", "line")).select("row_id", "ord", grammar.name_meta(F.col("line")).alias("m")).select("row_id", "ord", "m.*")


@query()
def appointed_psalms_all(spark, d):
    """Every psalm entry of both offices, every branch and choice, with how many verses the common psalter holds for it (0 if none)."""
    f = _psalm_entries_of_offices(spark, d)
    v = _psalter(spark, d).where("psalter = 'psalter_common' AND type = 'verse'").select(F.col("psalm").try_cast("int").alias("num"), F.col("seq").alias("v")).where("num IS NOT NULL").distinct()
    # one row a psalm, so that an entry meets one row and not all its verses
    per = v.groupBy("num").agg(F.collect_list("v").alias("vs"))
    inside = F.filter("vs", lambda x: F.col("first").isNull() | x.between(F.col("first"), F.col("last")))
    return f.join(per, "num", "left").withColumn("verses", F.coalesce(F.size(inside).cast("bigint"), F.lit(0))).select("row_id", "office", "slot", "choice", "ord", "num", "first", "last", "optional", "verses")


@query()
def office_assembly(spark, d):
    """The composite: the offices of every calendar's every date, from forms with their shared blocks, psalter and collects."""
    cal = _calendar(spark, d)
    last = readers.keep_last(cal.select("calendar_id", "cal_date", "src_file", "row_id", "name", "eucharist", "morning", "evening", "extra"), ["calendar_id", "cal_date"], [F.col("src_file"), F.col("row_id")])
    days = office.parse_days(last.withColumnRenamed("cal_date", "date"))
    bounds = small(spark, _BOUNDS, "key string, d string").select("key", F.to_date("d").alias("start"))
    s = written(_segments(spark, d).select("form", "section_ord", "section", "seq", "kind", "text", "group_label", "shared_key"))  # read by every level of shared blocks
    blocks = s.where("form = '_shared'").select(F.col("section").alias("key"), "seq", "kind", "text", "group_label", "shared_key")
    forms = segments.expand_shared(s.where("form <> '_shared'"), blocks)
    # all_saints_mp_0000012 serves allsaints-mp, ordinary_mp_0000007 the seven ordinary-…day-mp
    season, hour = F.replace(F.regexp_extract("form", r"^(.*)_[a-z]+_\d+$", 1), F.lit("_"), F.lit("")), F.regexp_extract("form", r"_([a-z]+)_\d+$", 1)
    names = F.when(season == "ordinary", F.array(*[F.lit(f"ordinary-{x}") for x in ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")])).otherwise(F.array(season))
    editions = s.where("form <> '_shared'").select("form").distinct().select("form", F.explode(names).alias("name")).select("form", F.concat_ws("-", "name", hour).alias("key"))
    lines = written(_psalter(spark, d))
    p = lines.where("psalter = 'psalter_common' AND type <> 'head'").select(F.col("psalm").try_cast("int").alias("num"), F.col("seq").alias("v"), "text")
    # no table of scripture: each book the calendar cites is read from a psalter, psalms for chapters
    placed = Window.partitionBy("psalter", "psalm").orderBy("page_no", "seq", "line_id")
    verses = lines.where("type = 'verse' AND text IS NOT NULL").select(F.col("psalter").alias("book"), F.col("psalm").try_cast("int").alias("ch"), F.row_number().over(placed).alias("v"), "text").where("ch IS NOT NULL")
    in_turn = lambda df, name: df.distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name)) - 1)  # noqa: E731  # a row per book
    cited = _offices(spark, d).select(F.explode(F.regexp_extract_all("raw", F.lit(_CITE), F.lit(0))).alias("c")).select(grammar.citation(F.col("c")).getField("book").alias("abbrev")).where("abbrev <> 'Ps'")
    psalters = checkpoint(in_turn(verses.select("book"), "book"))
    books = in_turn(cited, "abbrev").withColumn("i", F.pmod("i", F.lit(max(psalters.count(), 1)))).join(psalters, "i").select("abbrev", "book")
    collects = lines.where("type = 'head'").groupBy(F.col("page_no").cast("string").alias("page")).agg(F.min("title").alias("text"))
    return office.assemble(days, bounds, forms, p, verses, books, collects, editions)


@query("""
    SELECT c.c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 2) AS revenue
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def customer_assembly(spark, d):
    # lines are aggregated to orders, and orders to customers, before each join
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.sum("revenue").alias("revenue"))
    out = table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0)
    return out.select("c_custkey", "orders", "lines", F.round("revenue", 2).alias("revenue"))


@query("""
    SELECT DISTINCT line_id, CASE WHEN regexp_matches(raw_line, '^"?\\d{4}-\\d{2}-\\d{2}') THEN 'dated' ELSE 'undated' END AS outcome FROM calendar_raw""")
def raw_line_scan(spark, d):
    raw = table(spark, d, "calendar_raw").select("line_id", "raw_line").dropDuplicates(["line_id"])
    return raw.select("line_id", F.when(F.col("raw_line").rlike(r'^"?\d{4}-\d{2}-\d{2}'), "dated").otherwise("undated").alias("outcome"))


@query()
def reject_edits(spark, d):
    """The edits that would repair each failing record."""
    return parse_records(table(spark, d, "calendar_raw"), "line_id", "raw_line", CALENDAR).where("reason IS NOT NULL").select("line_id", "reason", "field", "edits")


_NEAR = [("quiet gates",), ("first sheaves",), ("nine bell",), ("kept doors",), ("late rains",), ("salt covenants",), ("lantern",), ("hidden springs",)]


@query()
def similarity_nearmiss(spark, d):
    """Names close to a misspelled phrase, which they do not hold."""
    held = F.regexp_extract_all("name", F.lit(r"(?:of|after) (?:the )?([A-Z][a-z]+(?: [A-Z][a-z]+)?)"), F.lit(1))
    names = _calendar(spark, d).where("name IS NOT NULL").select(F.explode(held).alias("n")).select(F.lower("n").alias("n")).where("n <> ''").distinct()
    phrases = F.broadcast(small(spark, _NEAR, "phrase string"))
    near = names.join(phrases, ~F.contains(F.col("n"), F.col("phrase"))).withColumn("ratio", text.similarity(F.col("n"), F.col("phrase"))).where("ratio >= 0.72")
    return near.groupBy("n").agg(F.max_by("phrase", F.struct("ratio", -F.length("phrase"))).alias("phrase"), F.round(F.max("ratio"), 3).alias("ratio"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_event_windows(spark, d):
    """Events read as a stream into daily windows; the final state is written to the shared folder and read again."""
    import uuid

    from ferial.streaming.deliveries import counts_by_window

    path = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    src = table(spark, d, "events")
    # a directory of files is the source, the table's own schema the contract
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = counts_by_window(stream, "ts", "1 day", "event_type")
    run = (
        counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
        .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.to_date("start").alias("day"), "event_type", "n")


@query(f"""
    WITH s AS (SELECT psalter, psalm, page_no AS page, seq, CASE WHEN type = 'cont' THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS x0, text FROM {_PSA} WHERE text IS NOT NULL),
         l AS (SELECT psalter, psalm, page, seq, min(x0) AS x, string_agg(text, ' ' ORDER BY x0, text) AS t FROM s GROUP BY 1, 2, 3, 4)
    SELECT psalter, psalm, page, CAST(row_number() OVER (PARTITION BY psalter, psalm, page ORDER BY seq) - 1 AS INT) AS line, CAST(seq * 12 AS DOUBLE) AS y, x, {_STRIPPED.format('t')} AS text FROM l""")
def geometry_lines(spark, d):
    """The lines of every psalter laid on pages as spans and read back; ``seq`` counts within a psalm's part of a page."""
    spans = _psalter(spark, d).where("text IS NOT NULL").select(
        "psalter", "psalm", F.col("page_no").alias("page"), (F.when(F.col("type") == "cont", 40.0).otherwise(20.0)).alias("x0"), (F.col("seq") * 12.0).alias("y0"), "text"
    )
    return geometry.lines_of(spans, part=("psalter", "psalm", "page"))
