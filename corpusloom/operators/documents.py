"""Documents and collections as aggregates over stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each id: re-delivered rows equal the first in all but the time they were stored."""
    return chunks.dropDuplicates(["id"])


def document_info(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"),
        F.sum(F.length("content")).alias("total_characters"),
        F.count_distinct("page_number").alias("page_count"),
        F.min("file_name").alias("file_name"),
        F.floor(F.min(F.unix_timestamp("created_at"))).alias("created_at_s"),
    )


def list_documents(chunks: DataFrame) -> DataFrame:
    return (
        chunks.groupBy(F.coalesce("document_id", F.lit("unknown")).alias("document_id"))
        .agg(F.count("*").alias("chunk_count"), F.sum(F.length("content")).alias("total_characters"))
        .withColumn("average_chunk_size", F.round(F.col("total_characters") / F.col("chunk_count"), 6))
    )


def documents_page(chunks: DataFrame, limit: int = 50) -> DataFrame:
    return list_documents(chunks).orderBy("document_id").limit(limit)


def find_documents(chunks: DataFrame, text: str) -> DataFrame:
    return list_documents(chunks).where(F.lower("document_id").contains(text.lower()))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """Exact totals over the whole collection."""
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_distinct("document_id").alias("documents"),
        F.sum(F.length("content")).alias("characters"),
        F.round(F.avg(F.length("content")), 6).alias("average_chunk_size"),
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def processing_summary(results: DataFrame) -> DataFrame:
    """Runs by outcome with their totals; repeated rows count once, negative times don't count."""
    once = results.dropDuplicates(["run_id"])
    time = F.when(F.col("processing_time") >= 0, F.col("processing_time"))
    return once.groupBy("success").agg(
        F.count("*").alias("runs"), F.count_distinct("document_id").alias("documents"),
        F.sum("chunks_processed").alias("chunks"), F.sum("embeddings_generated").alias("embeddings"), F.sum("chunks_stored").alias("stored"),
        F.round(F.sum(time), 6).alias("seconds"), F.round(F.sum("chunks_processed") / F.sum(time), 4).alias("chunks_per_second"),
    )
