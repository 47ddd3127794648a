"""Incremental ingest of measurement files (an extension: the study itself is batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corridor import segment_springs

KEY = ["segment_id", "year"]
BUCKETS = 64


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def current(spark: SparkSession, results: str) -> DataFrame:
    """The newest version of every bucket of the results."""
    rows = spark.read.option("basePath", results).parquet(results)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # from the folders' names: one row a bucket
    return rows.join(F.broadcast(newest), ["bucket", "version"]).drop("bucket", "version")


def upsert(spark: SparkSession, batch: DataFrame, number: int, store: str, results: str, buckets: int = BUCKETS) -> list[int]:
    """M1: add a batch to the store and recompute the (segment, year) keys that it touches; the buckets that got a new version.

    Store and results are dealt into buckets of keys.  Only touched buckets are read, only touched keys are recomputed, and what
    else a bucket holds is carried over into its new version.  A batch writes under its number, so when it comes again it puts
    the same files in the same place, and a version that was not finished is written anew; readers see whole versions.
    """
    dealt = batch.withColumn("bucket", bucket_of(buckets))
    dealt.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(store)
    touched = sorted(r[0] for r in dealt.select("bucket").distinct().collect())  # as many as there are buckets, at most
    stored = spark.read.parquet(store).where(F.col("bucket").isin(touched) & (F.col("batch") <= number))
    keys = stored.where(F.col("batch") == number).select(*KEY).distinct()
    fresh = segment_springs(stored.join(keys, KEY, "left_semi").drop("batch", "bucket")).withColumn("bucket", bucket_of(buckets))
    before = _before(spark, results, number, touched)
    if before is not None:
        fresh = fresh.unionByName(before.join(keys, KEY, "left_anti"))
    fresh.withColumn("version", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(results)
    return touched


def _before(spark: SparkSession, results: str, number: int, touched: list[int]) -> DataFrame | None:
    """What the touched buckets held before this batch."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(results)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    rows = spark.read.option("basePath", results).parquet(results).where(F.col("bucket").isin(touched) & (F.col("version") < number))
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"]).drop("version")


def ingest(spark: SparkSession, incoming: str, schema: str, store: str, results: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """M1: take the files that have arrived; see ``upsert``."""

    def step(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, batch, number, store, results, buckets)

    stream = spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
