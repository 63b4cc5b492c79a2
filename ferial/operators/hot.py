"""Order within keys of any size: large keys are cut into buckets at approximate quantiles, so that no task sorts a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: keys of more rows than this are cut
LARGE = 10_000
_BUCKETS = 64


def bucketed(df: DataFrame, part: list[str], by: str) -> DataFrame:
    """Each row with ``__b``: 0 in small keys, else its bucket in the order of ``by`` (a number, date or time; nulls come first), and
    ``__n``, the rows of its key. Rows equal in ``by`` share a bucket. Null keys are a key."""
    value = _number(df, by)
    renamed = [F.col(k).alias(f"__p{i}") for i, k in enumerate(part)]
    sizes = df.groupBy(*renamed).agg(F.count("*").alias("__n"), F.percentile_approx(value, [i / _BUCKETS for i in range(1, _BUCKETS)], 10_000).alias("__c"))
    # only large keys need their cut points; their list is short, small keys carry none
    sizes = sizes.withColumn("__c", F.when(F.col("__n") > LARGE, F.col("__c")))
    same = F.lit(True)
    for i, k in enumerate(part):
        same = same & F.col(k).eqNullSafe(F.col(f"__p{i}"))
    bucket = F.when(F.col("__c").isNull() | value.isNull(), 0).otherwise(F.size(F.filter("__c", lambda c: c < value)) + 1)
    return df.join(sizes, same).withColumn("__b", bucket).drop("__c", *[f"__p{i}" for i in range(len(part))])


def _number(df: DataFrame, by: str) -> Column:
    kind = df.schema[by].dataType.simpleString()
    if kind == "date":
        return F.unix_date(by).cast("double")
    return (F.col(by).cast("timestamp") if kind == "timestamp_ntz" else F.col(by)).cast("double")


def row_at(df: DataFrame, part: list[str], order: list[str], place: Column) -> DataFrame:
    """The row of every key at ``place`` (from 0, over ``__n``, the rows of the key) in ``order``: bucket counts tell which bucket
    holds it, and only that one is ranked."""
    placed = bucketed(df, part, order[0])
    w = Window.partitionBy(*part).orderBy("__b")  # a row per bucket
    counts = placed.groupBy(*part, "__b", "__n").agg(F.count("*").alias("__k")).withColumn("__before", F.sum("__k").over(w) - F.col("__k"))
    hit = counts.withColumn("__want", place - F.col("__before")).where("__want >= 0 AND __want < __k")
    hit = hit.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(part)], F.col("__b").alias("__b2"), "__want")
    same = F.col("__b") == F.col("__b2")
    for i, k in enumerate(part):
        same = same & F.col(k).eqNullSafe(F.col(f"__p{i}"))
    inside = placed.join(hit, same)
    ranked = inside.withColumn("__r", F.row_number().over(Window.partitionBy(*part, "__b").orderBy(*order)) - 1)
    return ranked.where("__r = __want").select(*df.columns)


def last_known(df: DataFrame, part: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """Each row with ``name``: the last ``marker`` that is not null at or before it. Of every bucket its last marker is carried to the
    buckets after it, so buckets work alone."""
    marked = bucketed(df, part, order[0]).withColumn("__m", marker)
    place = F.when(F.col("__m").isNotNull(), F.struct(*order))
    ends = marked.groupBy(*part, "__b").agg(F.max_by("__m", place).alias("__end"))
    before = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carried = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(before))
    carried = carried.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(part)], F.col("__b").alias("__b2"), "__before")
    same = F.col("__b") == F.col("__b2")
    for i, k in enumerate(part):
        same = same & F.col(k).eqNullSafe(F.col(f"__p{i}"))
    w = Window.partitionBy(*part, "__b").orderBy(*order)
    out = marked.join(carried, same).withColumn(name, F.coalesce(F.last("__m", ignorenulls=True).over(w), F.col("__before")))
    return out.select(*[c for c in df.columns if c != name], name)


def running_sum(df: DataFrame, part: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with ``name``: the sum of ``value`` up to and with it. Sums of whole buckets come first, so buckets work alone."""
    marked = bucketed(df, part, order[0]).withColumn("__v", value)
    sums = marked.groupBy(*part, "__b").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carried = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    carried = carried.select(*[F.col(k).alias(f"__p{i}") for i, k in enumerate(part)], F.col("__b").alias("__b2"), "__before")
    same = F.col("__b") == F.col("__b2")
    for i, k in enumerate(part):
        same = same & F.col(k).eqNullSafe(F.col(f"__p{i}"))
    w = Window.partitionBy(*part, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = marked.join(carried, same).withColumn(name, F.sum("__v").over(w) + F.col("__before"))
    return out.select(*[c for c in df.columns if c != name], name)
