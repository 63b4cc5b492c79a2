"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir`` (shared storage). Only where neither the
    setting nor the context has one (local tests) a temporary folder is made.
    """
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        # one process on one machine: the folder goes with it
        named = tempfile.mkdtemp(prefix="ferial-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder: a cut of lineage for rows that are read more than once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_below(df: DataFrame, weight: Column, most: int) -> DataFrame:
    """``df`` marked for broadcast where the sum of ``weight`` over its rows is at most ``most``; a written table, it is read twice."""
    total = df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def null_safe_hash(*cols: Column) -> Column:
    """64-bit hash in which a null differs from every value and from a null in another place.

    ``xxhash64`` skips nulls, so the null flags are hashed as well.
    """
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def text_digest(col: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text; together a 128-bit identity."""
    return F.xxhash64(col), F.xxhash64(F.reverse(col))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table as a local relation: its size is known to the planner, and reading it is no job."""
    shape = StructType.fromDDL(schema)
    arrow = to_arrow_schema(shape)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(shape.names, r)) for r in rows], schema=arrow), shape)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
