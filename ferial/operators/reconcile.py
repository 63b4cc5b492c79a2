"""Differences between two copies of one data set, by hierarchical checksums.

Every key gets a position in a 63-bit key space (a hash of the key, so positions are even
whatever the keys look like). Each copy is reduced to the version of every key that is in
force; per finest range of positions a checksum (the XOR of two independent row digests, and a
count) is built, and from there every level of a tree from the level below it. The trees are compared from
the root: of each level only the children of ranges that differ are looked at. Field values are read, shuffled and
compared in the finest differing ranges only.

At scale: the first pass shuffles digests instead of values; the tree has one leaf for ``leaf_rows`` keys and a
256th more above them, so that all of it is written once and read once; the second pass moves only rows of
differing ranges. A key repeated in a third of all rows is pre-aggregated before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferial.runtime import broadcast_below, checkpoint, null_safe_hash, written

_BITS = 63
_BROADCAST_LEAVES = 1_000_000


def _positioned(df: DataFrame, keys: list[str], depth: int) -> DataFrame:
    pos = null_safe_hash(*[F.col(k) for k in keys])
    return df.withColumn("__leaf", F.shiftrightunsigned(pos, 64 - depth) if depth else F.lit(0).cast("bigint"))


def _prepared(df: DataFrame, keys: list[str], fields: list[str], version: str | None, depth: int) -> DataFrame:
    names = [*keys, *fields]
    cols = [F.col(f"`{c}`").alias(c) for c in names]
    cols.append((F.col(f"`{version}`") if version else F.lit(None).cast("timestamp")).alias("__version"))
    return _positioned(df.select(*cols), keys, depth)


def _digests(fields: list[str]) -> tuple:
    cols = [F.col(f) for f in fields]
    reversed_ = [F.reverse(F.col(f).cast("string")) for f in fields]
    return null_safe_hash(*cols).alias("h1"), null_safe_hash(*reversed_).alias("h2")


def checksum_leaves(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finest key range: the difference of the two copies' counts and of two XOR digests."""

    def in_force(df: DataFrame, fields: list[str], side: int) -> DataFrame:
        h1, h2 = _digests(fields)
        return (
            df.groupBy("__leaf", *keys)
            .agg(F.max(F.struct(F.col("__version"), h1, h2)).alias("__v"))
            .select(
                "__leaf",
                F.lit(side).alias("side"),
                F.xxhash64(null_safe_hash(*[F.col(k) for k in keys]), "__v.h1", F.lit(1)).alias("d1"),
                F.xxhash64("__v.h2", null_safe_hash(*[F.col(k) for k in reversed(keys)]), F.lit(2)).alias("d2"),
            )
        )

    fields = [c for c in left.columns if c not in {*keys, "__version", "__leaf"}]
    both = in_force(left, fields, 1).unionByName(in_force(right, fields, -1))
    # equal rows of the two copies cancel in the XOR, so a range is equal where nothing is left of it
    return both.groupBy("__leaf").agg(F.sum("side").alias("n"), F.bit_xor("d1").alias("x1"), F.bit_xor("d2").alias("x2"))


def checksum_tree(leaves: DataFrame, depth: int, step: int) -> list[DataFrame]:
    """The levels of the tree from the leaves to the root, each built from the one below: ``node, n, x1, x2``."""
    levels = [checkpoint(leaves.withColumnRenamed("__leaf", "node"))]
    while depth > 0:
        up = F.shiftright("node", min(step, depth)).alias("node")
        levels.append(checkpoint(levels[-1].groupBy(up).agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))))
        depth -= step
    return levels


def differing_leaves(levels: list[DataFrame], depth: int, step: int) -> DataFrame:
    """Walks the checksum tree from the root; of every level only children of ranges that differ are compared."""
    differ = (F.col("n") != 0) | (F.col("x1") != 0) | (F.col("x2") != 0)
    shifts = [min(step, depth - step * i) for i in range(len(levels) - 1)]
    found = levels[-1].where(differ).select("node")
    for level, shift in zip(levels[-2::-1], reversed(shifts)):
        up = found.select(F.col("node").alias("up"))
        found = level.withColumn("up", F.shiftright("node", shift)).join(up, "up", "left_semi").where(differ).select("node")
    return found.select(F.col("node").alias("__leaf"))


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    version: str | None = None,
    left_only: str = "only_left",
    right_only: str = "only_right",
    leaf_rows: int = 16,
    step: int = 8,
) -> DataFrame:
    """Rows ``keys + (diff)``: a key in force on one side only, or one row per differing field.

    Defined results: of several versions of a key the one with the greatest ``version`` holds
    (null is the oldest; of equal versions the one with the greater digest, alike in both
    copies). Nulls in keys are ordinary key values and a null field equals only a null.
    Repeated rows count once. Empty tables: everything is on the other side. Other columns
    are ignored, whatever their names. ``leaf_rows`` is the aimed number of keys in the finest range,
    ``step`` the number of bisections between two compared levels.
    """
    n = max(left.count(), right.count())
    depth = min(_BITS, max(0, math.ceil(math.log2(max(n, 1) / leaf_rows)))) if n > leaf_rows else 0
    lhs, rhs = (_prepared(x, keys, fields, version, depth) for x in (left, right))
    wanted = written(differing_leaves(checksum_tree(checksum_leaves(lhs, rhs, keys), depth, step), depth, step))
    wanted = broadcast_below(wanted, F.lit(1), _BROADCAST_LEAVES)

    h1, h2 = _digests(fields)
    version_key = F.struct(F.col("__version"), h1, h2, F.struct(*fields).alias("v"))
    rows = (
        lhs.withColumn("__side", F.lit(0))
        .unionByName(rhs.withColumn("__side", F.lit(1)))
        .join(wanted, "__leaf", "left_semi")
    )
    pairs = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("__side") == 0, version_key)).alias("__l"),
        F.max(F.when(F.col("__side") == 1, version_key)).alias("__r"),
    )
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    kinds = [
        F.when(F.col("__r").isNull(), F.lit(left_only)),
        F.when(F.col("__l").isNull(), F.lit(right_only)),
        *[F.when(both & ~F.col(f"__l.v.{f}").eqNullSafe(F.col(f"__r.v.{f}")), F.lit(f)) for f in fields],
    ]
    return pairs.select(*keys, F.explode(F.array_compact(F.array(*kinds))).alias("diff"))
