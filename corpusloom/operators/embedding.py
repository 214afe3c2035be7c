"""Embedding of texts through pluggable Arrow functions, with a cache table and cost estimates."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import for_embedding, tokens
from corpusloom.runtime import checkpoint, spread

Embedder = Callable[[list[str]], np.ndarray]

# Price of a thousand tokens by model.
PRICES = {"text-embedding-3-small": 0.00002, "text-embedding-3-large": 0.00013, "text-embedding-ada-002": 0.0001}


def hash_embedder(dimension: int = 64) -> Callable[[], Embedder]:
    """A deterministic embedder without a model: signed hashing of the words, unit length."""

    def make() -> Embedder:
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), np.float32)
            for k, text in enumerate(texts):
                for word in text.lower().split():
                    h = xxhash.xxh3_64_intdigest(word)
                    out[k, h % dimension] += 1.0 if h >> 63 else -1.0
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(size > 0, size, 1)

        return embed

    return make


def pauses(strategy: str = "exponential", base_delay: float = 0.1, multiplier: float = 2.0, max_delay: float = 60.0) -> Iterator[float]:
    """Seconds to wait before each further attempt."""
    a, b, k = 1, 1, 0
    while True:
        factor = {"fixed": 1, "linear": k + 1, "exponential": multiplier**k, "fibonacci": a}[strategy]
        yield min(max_delay, base_delay * factor)
        a, b, k = b, a + b, k + 1


def with_retry(
    embed: Embedder, attempts: int = 3, base_delay: float = 0.1, multiplier: float = 2.0, *, strategy: str = "exponential", max_delay: float = 60.0,
    jitter: float = 0.0, final: tuple[type[Exception], ...] = (),
) -> Embedder:
    """Tries again after pauses, by up to the share ``jitter`` longer or shorter; errors of the kinds ``final`` and the last one go up, and Spark tries the task again."""

    def run(texts: list[str]) -> np.ndarray:
        waits = pauses(strategy, base_delay, multiplier, max_delay)
        for k in range(attempts):
            try:
                return embed(texts)
            except Exception as e:
                if k == attempts - 1 or isinstance(e, final):
                    raise
                time.sleep(next(waits) * (1 + random.uniform(-jitter, jitter)))
        raise AssertionError

    return run


def embed_texts(texts: DataFrame, make: Callable[[], Embedder], *, id_col: str = "id", text_col: str = "text", batch: int = 256, attempts: int = 3) -> DataFrame:
    """(id, embedding): the embedder is made once in each task and fed in batches."""
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = with_retry(make(), attempts)
        for rows in batches:
            values = rows.column(1).to_pylist()
            parts = [embed(values[at : at + batch]) for at in range(0, len(values), batch)]
            matrix = np.vstack(parts).astype(np.float32) if parts else np.zeros((0, 1), np.float32)
            flat = pa.array(matrix.ravel())
            ends = pa.array(np.arange(0, flat.__len__() + 1, matrix.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(ends, flat)], ["id", "embedding"])

    src = texts.select(F.col(id_col).alias("id"), F.coalesce(for_embedding(F.col(text_col)), F.lit("[EMPTY]")).alias("text"))
    return spread(src).mapInArrow(run, f"id {kind}, embedding array<float>")


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("‖", F.lit(model), text), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Distinct texts whose key isn't in the cache."""
    keyed = texts.select(cache_key(model, F.col(text_col)).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")


def cached_embeddings(texts: DataFrame, cache: DataFrame, model: str, make: Callable[[], Embedder], *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, embedding) of all distinct texts, and those of them to be added to the cache: each text is embedded at most once."""
    keyed = texts.select(cache_key(model, F.col(text_col)).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    known = cache.select("key", "embedding").dropDuplicates(["key"])
    fresh = checkpoint(embed_texts(keyed.join(known.select("key"), "key", "left_anti"), make, id_col="key").withColumnRenamed("id", "key"))
    held = known.join(keyed.select("key"), "key", "left_semi")
    return held.unionByName(fresh), fresh


def embed_chunks(chunks: DataFrame, make: Callable[[], Embedder], *, model: str, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The chunks with their ``embedding``, its ``dimension`` and the ``model``; equal contents are embedded once."""
    keyed = chunks.withColumn("_key", cache_key(model, F.coalesce(F.col(text_col), F.lit(""))))
    once = keyed.select("_key", F.col(text_col).alias("text")).dropDuplicates(["_key"])
    vectors = embed_texts(once, make, id_col="_key").withColumnRenamed("id", "_key")
    return keyed.join(vectors, "_key").drop("_key").withColumns({"dimension": F.size("embedding"), "model": F.lit(model)})


def cost_estimate(texts: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    words = F.sum(F.size(tokens(F.col(text_col))))
    return texts.agg(
        F.count("*").alias("texts"), F.round(words * 1.3, 4).alias("tokens"), F.round(words * 1.3 / 1000 * F.lit(PRICES[model]), 8).alias("cost")
    )
