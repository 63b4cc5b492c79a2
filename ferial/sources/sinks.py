"""Writers: month partitions, windows of retention, mirrors, manifests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferial.runtime import small


def write_months(days: DataFrame, path: str, date: str = "date") -> None:
    """JSON files partitioned by month; only months that have rows are replaced."""
    out = days.withColumn("month", F.date_format(date, "yyyy-MM")).repartition("month").sortWithinPartitions("month", date)
    out.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def in_window(month: Column, today: str, months: int) -> Column:
    """Is a ``yyyy-MM`` key within ``months`` of 31 days around ``today``?"""
    at = F.lit(today).cast("date")
    return month.between(F.date_format(F.date_sub(at, 31 * months), "yyyy-MM"), F.date_format(F.date_add(at, 31 * months), "yyyy-MM"))


def write_window(days: DataFrame, path: str, today: str, months: int, date: str = "date") -> None:
    """The months of the window and nothing else: what lies outside or is no longer produced goes."""
    out = days.withColumn("month", F.date_format(date, "yyyy-MM")).where(in_window(F.col("month"), today, months))
    out.repartition("month").write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "static").json(path)


def mirror(src: DataFrame, path: str) -> None:
    """An exact copy; an empty source is refused, so that nothing is wiped by mistake."""
    if src.isEmpty():
        raise ValueError("the source is empty; nothing was written")
    src.write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, sha256, bytes`` of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def composite_hash(manifest: DataFrame) -> DataFrame:
    """One hash over the sorted names and hashes of a manifest, whose rows are files (few and small)."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha256")))
    return manifest.agg(F.sha2(F.array_join(parts, "\n"), 256).alias("sha256"), F.count("*").alias("files"))


def manifest(files: DataFrame, expected: list[str], versions: dict[str, str], at: str) -> DataFrame:
    """``name, sha256, bytes`` of the files of a manifest, a null hash for each expected name that is absent, and the versions of the tools and the
    time of writing as rows of their own (``version:…``, ``written``)."""
    spark = files.sparkSession
    here = files.select("name", "sha256", "bytes")
    absent = small(spark, [(n,) for n in expected], "name string").join(here.select("name"), "name", "left_anti")
    rows = [(f"version:{k}", v, None) for k, v in sorted(versions.items())] + [("written", at, None)]
    return here.unionByName(absent.select("name", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("bigint").alias("bytes"))).unionByName(small(spark, rows, "name string, sha256 string, bytes bigint"))


def manifest_drift(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """``name, drift``: changed, missing or new; a recorded null stands for a file that is absent."""
    both = current.select("name", F.col("sha256").alias("now")).join(recorded.select("name", F.col("sha256").alias("then")), "name", "full_outer")
    drift = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "missing").otherwise("changed")
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select("name", drift.alias("drift"))


def report(findings: DataFrame) -> DataFrame:
    """One JSON line per finding, in order."""
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("line")).orderBy("line")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as indented JSON documents, one a row, keys in the order of the columns."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_each(df: DataFrame, path: str, by: str) -> None:
    """A folder of JSON for every value of ``by``, such as a psalm's number."""
    df.repartition(by).write.partitionBy(by).mode("overwrite").json(path)
