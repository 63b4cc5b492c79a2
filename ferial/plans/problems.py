"""Queries of the general data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferial.operators.nested import flatten_forms
from ferial.operators.packed import explode_packed
from ferial.operators.reconcile import diff_copies
from ferial.operators.rejects import parse_records, split_good_and_bad
from ferial.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_copies(
        table(spark, sf_dir, "form_lines_app"),
        table(spark, sf_dir, "form_lines_print"),
        keys=["form", "section", "seq"],
        fields=["type", "text"],
        version="loaded_at",
        left_only="only_app",
        right_only="only_print",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "calendar_rows")
    return explode_packed(rows, "row_id", ["name", "morning", "evening"]).select("row_id", "field", "pos", "piece")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "calendar_raw")
    parsed = parse_records(raw, "line_id", "raw_line")
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason", "field")


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar rows that loaded, typed."""
    good, _ = split_good_and_bad(table(spark, sf_dir, "calendar_raw"), "line_id", "raw_line")
    return good.withColumn("cal_date", F.to_date("cal_date"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_forms(table(spark, sf_dir, "office_forms"), version="loaded_at")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p4_found, p4_loaded, p5_found)}

_UNQUOTED = "CASE WHEN starts_with(x, '\"') THEN replace(substr(x, 2, length(x) - 2), '\"\"', '\"') ELSE x END"
_STRIP = r"regexp_replace({0}, '^[ \t\r\n\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[ \t\r\n\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
_BAD = r"[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{FFFD}}]".replace("{{", "{").replace("}}", "}")
_HUES = "(?:White|Red|Green|Violet|Rose|Blue)"
_TITLE = rf"regexp_extract(x, '(?s)^(.*?)(?: - (?:PF|HD|Mem|Com))?(?: \({_HUES}(?:/{_HUES})?\))?$', 1)"
#: the contract of a record as TESTDATA.md states it, one field after the other
_JUDGED = rf"""(
    WITH r AS (SELECT line_id, coalesce(any_value(raw_line), '') AS raw FROM calendar_raw GROUP BY 1),
         q AS (SELECT *, regexp_full_match(raw, '(?s)(?:"(?:""|[^"])*"|[^",]*)(?:,(?:"(?:""|[^"])*"|[^",]*))*') AS quoted FROM r),
         f AS (SELECT *, CASE WHEN quoted THEN list_transform(regexp_extract_all(raw, '(?s)(?:^|,)("(?:""|[^"])*"|[^",]*)', 1), lambda x: {_STRIP.format(_UNQUOTED)}) END AS v FROM q),
         n AS (SELECT *, v[1] AS f1, v[2] AS f2, v[3] AS f3, coalesce(v[6], '') AS f6 FROM f),
         j AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(v) NOT IN (5, 6) THEN 'columns' END AS shape,
                 regexp_full_match(f1, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(f1 AS DATE) IS NOT NULL AS dated,
                 NOT regexp_matches(f2, '{_BAD}') AND len(list_filter(string_split(f2, '<br>'), lambda x: {_STRIP.format(_TITLE)} = '' OR starts_with({_TITLE}, '- ') OR contains({_TITLE}, ' - ') OR regexp_matches({_TITLE}, '[()\[\]]'))) = 0 AS named,
                 f3 = '' OR (NOT regexp_matches(f3, '{_BAD}') AND starts_with(f3, 'Collect of the Day: ') AND ends_with(f3, 'Amen.')) AS prayed,
                 f6 = '' OR (NOT regexp_matches(f6, '{_BAD}') AND len(list_filter(string_split(f6, '<br>'), lambda x: NOT regexp_full_match(x, '(?s)\[(?:pastoral|source|antiphon|rubric)\] \S.*'))) = 0) AS noted FROM n)
    SELECT line_id, v, coalesce(shape, CASE WHEN NOT (dated AND named AND prayed AND noted) THEN 'value' END) AS reason,
        CASE WHEN shape IS NOT NULL THEN 'row' WHEN NOT dated THEN 'cal_date' WHEN NOT named THEN 'name' WHEN NOT prayed THEN 'eucharist' WHEN NOT noted THEN 'extra' END AS field FROM j)"""

_FLAT = """
    WITH RECURSIVE f AS (SELECT form_id, arg_max(body, (loaded_at, body)) AS body FROM office_forms GROUP BY 1),
        x AS (SELECT f.form_id, j.id, j.parent, j.type, replace(replace(coalesce(j.key, ''), '~', '~0'), '/', '~1') AS key, json_extract_string(j.atom, '$') AS atom FROM (SELECT * FROM f WHERE json_valid(body)) f, json_tree(f.body) j),
        t AS (SELECT x.*, k.atom AS kind, s.atom AS shared FROM x LEFT JOIN x k ON k.form_id = x.form_id AND k.parent = x.id AND k.key = 'type' AND k.type = 'VARCHAR'
              LEFT JOIN x s ON s.form_id = x.form_id AND s.parent = x.id AND s.key = 'key' AND s.type = 'VARCHAR'),
        w AS (SELECT form_id, id, '' AS node, '' AS owner, 'branches' AS role, kind, shared FROM t WHERE parent IS NULL AND type = 'OBJECT'
              UNION ALL SELECT c.form_id, c.id, w.node || '/' || c.key,
                  CASE w.role WHEN 'branches' THEN '' WHEN 'list' THEN w.owner WHEN 'members' THEN w.owner WHEN 'groups' THEN w.owner ELSE w.node END,
                  CASE WHEN w.role = 'branches' THEN CASE WHEN c.type = 'ARRAY' THEN 'list' WHEN c.kind IS NOT NULL THEN 'segment' ELSE 'branches' END
                       WHEN w.role IN ('list', 'members', 'bare') THEN 'segment' WHEN w.role = 'segment' THEN 'groups' WHEN w.role = 'groups' THEN CASE WHEN c.type = 'ARRAY' THEN 'bare' ELSE 'group' END ELSE 'members' END,
                  c.kind, c.shared
              FROM w JOIN t c ON c.form_id = w.form_id AND c.parent = w.id
              WHERE (w.role = 'branches' AND c.type IN ('OBJECT', 'ARRAY')) OR (w.role IN ('list', 'members', 'bare') AND c.type = 'OBJECT') OR (w.role = 'segment' AND w.kind = 'alternatives' AND c.key = 'groups' AND c.type = 'ARRAY')
                  OR (w.role = 'groups' AND c.type IN ('OBJECT', 'ARRAY')) OR (w.role = 'group' AND c.key = 'segments' AND c.type = 'ARRAY'))
    SELECT form_id, node, owner AS parent, CASE WHEN role = 'segment' THEN coalesce(kind, '') ELSE 'group' END AS kind, CASE WHEN role = 'segment' AND kind = 'shared' THEN coalesce(shared, '') ELSE '' END AS shared_key
    FROM w WHERE role IN ('segment', 'group', 'bare')"""

ORACLE = {
    "p5_found": _FLAT,
    "p4_found": f"SELECT line_id, reason, field FROM {_JUDGED} WHERE reason IS NOT NULL",
    "p4_loaded": f"SELECT line_id, CAST(v[1] AS DATE) AS cal_date, v[2] AS name, v[3] AS eucharist, v[4] AS morning, v[5] AS evening, v[6] AS extra FROM {_JUDGED} WHERE reason IS NULL",
    "p1_found": """
        WITH a AS (SELECT form, section, seq, type, text FROM (
               SELECT *, row_number() OVER (PARTITION BY form, section, seq ORDER BY loaded_at DESC NULLS LAST) AS n FROM form_lines_app) WHERE n = 1),
             b AS (SELECT form, section, seq, type, text FROM (
               SELECT *, row_number() OVER (PARTITION BY form, section, seq ORDER BY loaded_at DESC NULLS LAST) AS n FROM form_lines_print) WHERE n = 1)
        SELECT form, section, seq, 'only_app' AS diff FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.form IS NOT DISTINCT FROM a.form AND b.section IS NOT DISTINCT FROM a.section AND b.seq IS NOT DISTINCT FROM a.seq)
        UNION ALL
        SELECT form, section, seq, 'only_print' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.form IS NOT DISTINCT FROM a.form AND b.section IS NOT DISTINCT FROM a.section AND b.seq IS NOT DISTINCT FROM a.seq)
        UNION ALL
        SELECT a.form, a.section, a.seq, 'type' FROM a JOIN b ON b.form IS NOT DISTINCT FROM a.form AND b.section IS NOT DISTINCT FROM a.section AND b.seq IS NOT DISTINCT FROM a.seq WHERE a.type IS DISTINCT FROM b.type
        UNION ALL
        SELECT a.form, a.section, a.seq, 'text' FROM a JOIN b ON b.form IS NOT DISTINCT FROM a.form AND b.section IS NOT DISTINCT FROM a.section AND b.seq IS NOT DISTINCT FROM a.seq WHERE a.text IS DISTINCT FROM b.text
    """,
}
