"""Exact vector search: one query, neighbours of a stored vector, or many queries at once.

A single query is a projection and a top-k. Many queries meet the rows in blocks of bounded size; each
block keeps the best k of its rows for every query, so the shuffle moves queries x k x
blocks rows, not the pairs. Ties go by id. Vectors of length zero have no cosine: a single query puts them
last, without a score, and with many queries they neither ask nor are found; nor are vectors of another dimension than the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.config import DocumentNotFoundError, SearchQuery
from corpusloom.functions import vector as V
from corpusloom.operators.filters import content_predicate, predicate

#: Numbers of the query vectors that one block sends to the tasks.
BLOCK_VALUES = 4_000_000


def search(vectors: DataFrame, q: SearchQuery, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest rows with ``score`` and ``rank``; ``min_score`` is applied to the nearest, after the limit."""
    rows = vectors.where(predicate(vectors, q.where)).where(content_predicate(q.where_document))
    scored = rows.withColumn("score", F.round(V.score(F.col(vector_col), list(q.vector), q.metric), 6))
    best = scored.orderBy(F.desc_nulls_last("score"), id_col).limit(q.n_results)
    ranked = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("score"), id_col)))  # n_results rows
    return ranked if q.min_score is None else ranked.where(F.col("score") >= q.min_score)


def stored_vector(vectors: DataFrame, key, *, id_col: str = "vec_id", vector_col: str = "embedding") -> list[float]:
    row = vectors.where(F.col(id_col) == key).select(vector_col).first()
    if row is None:
        raise DocumentNotFoundError(f"no vector {key}")
    return list(row[0])


def similar(vectors: DataFrame, key, n: int = 10, *, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest rows of a stored vector, without itself."""
    q = SearchQuery(tuple(stored_vector(vectors, key, id_col=id_col, vector_col=vector_col)), n, metric)
    return search(vectors.where(F.col(id_col) != key), q, id_col=id_col, vector_col=vector_col)


def metadata_search(rows: DataFrame, where: dict, limit: int, *, id_col: str = "id") -> DataFrame:
    """Rows that pass a filter, in the order of their ids, all with score 1."""
    return rows.where(predicate(rows, where)).orderBy(id_col).limit(limit).withColumn("score", F.lit(1.0))


def _unit(ids: np.ndarray, vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of this dimension that have a direction, at unit length, with their ids."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False))
    x = pc.list_flatten(vectors.filter(pa.array(fits))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return ids[fits][good], x[good] / norm[good, None]


def _best(query_ids: np.ndarray, score: np.ndarray, who: np.ndarray, k: int, same_set: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's row of scores the best k, ties by id, as (query, id, score) one below the other."""
    if same_set:
        score = np.where(query_ids[:, None] == who, -np.inf, score)
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
    else:
        least = np.full((len(score), 1), -np.inf)
    row, column = np.nonzero((score >= least) & np.isfinite(score))
    found, ids = score[row, column], who[column]
    order = np.lexsort((ids, -found, row))
    row, found, ids = row[order], found[order], ids[order]
    first = np.searchsorted(row, np.arange(len(score)))
    kept = np.arange(len(row)) - first[row] < k
    return query_ids[row[kept]], ids[kept], found[kept]


def _result(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


def _task_best(query_ids: np.ndarray, queries: np.ndarray, k: int, same_set: bool):
    """The best k of a task's rows for queries that were sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, x = _unit(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), queries.shape[1])
            if len(ids):
                held.append(_best(query_ids, np.round(queries @ x.T, 6), ids, k, same_set))
            if len(held) > 16:
                held = [_merged(held, k)]
        if held:
            yield _result(*_merged(held, k))

    return run


def _merged(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, ids, score = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return query[kept], ids[kept], score[kept]


_FOUND = "query_id bigint, vec_id bigint, score double"


def search_many(
    vectors: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", same_set: bool = True,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(query_id, vec_id, score, rank): the nearest k of every query by cosine, in one set itself left out.

    With ``same_set`` off, queries and vectors are two sets whose ids have nothing to do with each other.

    Queries of one block go to the tasks; more of them are shuffled, and each of their blocks meets each block of rows in a task.
    """
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    n, size = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(1, size or 1)
    blocks = -(-n * size // block_values)
    if blocks <= 1:
        table = asked.limit(block_values // size + 1).toArrow()  # one block
        ids, unit = _unit(table["id"].to_numpy(), table["v"].combine_chunks(), size)
        found = base.mapInArrow(_task_best(ids, unit, k, same_set), _FOUND) if len(ids) else base.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    else:
        parts = max(1, -(-base.count() * size // block_values))
        place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        left = asked.select("id", "v", place(blocks).alias("q"), every(parts).alias("b"))
        right = base.select("id", "v", every(blocks).alias("q"), place(parts).alias("b"))

        def meet(asking: pa.Table, there: pa.Table) -> pa.Table:
            ids, unit = _unit(asking["id"].to_numpy(), asking["v"].combine_chunks(), size)
            who, x = _unit(there["id"].to_numpy(), there["v"].combine_chunks(), size)
            out = [_best(ids[at : at + 256], np.round(unit[at : at + 256] @ x.T, 6), who, k, same_set) for at in range(0, len(ids), 256)] if len(who) else []
            return pa.Table.from_batches([_result(*o) for o in out] or [_result(*[np.empty(0)] * 3)])

        found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(meet, _FOUND)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_within(chunks: DataFrame, q: SearchQuery, *, document: str | None = None, page: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The nearest chunks among those of a document, or of one of its pages; the query's own filter holds as well."""
    inside = {k: v for k, v in (("document_id", document), ("page_number", page)) if v is not None}
    both = [f for f in (q.where, inside) if f]
    where = {"$and": both} if len(both) > 1 else (both[0] if both else None)
    return search(chunks, replace(q, where=where), id_col=id_col, vector_col=vector_col)
