"""Calendar deliveries as a stream: duplicates dropped within a watermark, the latest version upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferial.sources.readers import keep_last


def distinct_deliveries(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each delivered row once, as long as its repeats come within ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, at: str, width: str, by: str, late: str = "1 hour") -> DataFrame:
    """Deliveries per window and ``by``; a window closes when the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def upsert_stream(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps ``path`` at the latest version of every key: rows lie in folders by a hash of their key, and a micro-batch
    rewrites only the folders its keys fall in. A batch that runs twice changes nothing the second time.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        newest = keep_last(batch, keys, [F.col(at)]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in newest.select("bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
                old = spark.read.schema(newest.schema).parquet(path).where(F.col("bucket").isin(touched))
                merged = keep_last(old.unionByName(newest), [*keys, "bucket"], [F.col(at)])
            else:
                merged = newest
            merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        finally:
            newest.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
