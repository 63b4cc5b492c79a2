"""Queries of the text problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferial.llm.leakage import find_leaks
from ferial.llm.lookalike import lookalike_classes, lookalike_pairs
from ferial.llm.mixture import mixture, shares
from ferial.llm.sentences import split_sentences
from ferial.llm.spans import shared_chars
from ferial.runtime import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "segments").select(F.col("seg_id").alias("id"), "text")
    lines = table(spark, sf_dir, "psalter_lines").select(F.col("line_id").alias("id"), "text")
    return segments.unionByName(lines)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_lines(spark, sf_dir), "id", "text")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes behind the pairs: one row per row, whatever the size of a class."""
    return lookalike_classes(_lines(spark, sf_dir), "id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_chars(table(spark, sf_dir, "segments"), "seg_id", "text", 80)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", 15)
    return leaks.select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p6_found, p7_found, p8_mixture, p8_shares, p9_found)}

ORACLE: dict[str, str] = {
    # every window of 80 characters of every text, without any symbols
    "p6_found": """
        WITH s AS (SELECT DISTINCT seg_id, text FROM segments WHERE length(text) >= 80),
             w AS (SELECT seg_id, text, unnest(generate_series(1, length(text) - 79)) AS pos FROM s), x AS (SELECT seg_id, pos, substr(text, pos, 80) AS part FROM w),
             h AS (SELECT part FROM x GROUP BY 1 HAVING min(seg_id) <> max(seg_id)), c AS (SELECT DISTINCT seg_id, pos FROM x JOIN h ON x.part = h.part),
             g AS (SELECT seg_id, least(80, coalesce(lead(pos) OVER (PARTITION BY seg_id ORDER BY pos) - pos, 80)) AS n FROM c)
        SELECT seg_id, CAST(sum(n) AS BIGINT) AS shared_chars FROM g GROUP BY 1""",
}
