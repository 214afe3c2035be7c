"""Streaming ingest of stored chunks: late and repeated rows, and counts by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a chunk table, present and to come."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def first_deliveries(stream: DataFrame, delay: str = "90 days") -> DataFrame:
    """Each chunk once, however often it is delivered within the delay; the state holds the ids of that time only. Chunks without a time are left out."""
    return stream.where("created_at is not null").withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def counts_by_month(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.window("created_at", "30 days").alias("w")).agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters")
    )


def run_to_end(stream: DataFrame, counts: Callable[[DataFrame], DataFrame], key: str, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there; the counts of all epochs, added up by ``key``.

    Each epoch writes its counts to a folder of its own, which a repeated epoch overwrites, so every row counts once.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, epoch: int) -> None:
        counts(df).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    empty = counts(spark.createDataFrame([], stream.schema))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark.read.schema(empty.schema).parquet(f"{path}/epoch=*") if fs.exists(at) else empty
    return done.groupBy(key).agg(*[F.sum(c).alias(c) for c in empty.columns if c != key])
