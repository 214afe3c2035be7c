"""Queries over stored chunks, processing logs and the embedding cache, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import chunking, documents, embedding, store
from corpusloom.runtime import checkpoint, ensure_checkpoint_dir, table
from corpusloom.plans.text_queries import _PAGE_ID, _PAGES
from corpusloom.streaming import ingest


def _chunks(spark, base):
    return documents.latest_chunks(table(spark, base, "text_chunks"))


_ONCE = "x AS (SELECT DISTINCT * EXCLUDE (stored_at, source_info) FROM text_chunks)"


def upsert_result(spark, base):
    """New versions of the chunks of page 2 replace the old ones, and one more chunk comes with each."""
    old = _chunks(spark, base).select("id", "page_number", "content")
    changed = old.where("page_number = 2").withColumn("content", F.concat(F.coalesce("content", F.lit("")), F.lit(" (revised)")))
    extra = changed.withColumn("id", F.concat("id", F.lit("_x")))
    return store.upsert(old, changed.unionByName(extra)).select("id", F.md5(F.encode("content", "UTF-8")).alias("hash"))


def delete_document_result(spark, base):
    left = store.without_document(_chunks(spark, base), "compendium-main")
    return left.groupBy("document_id").agg(F.count("*").alias("chunks"))


def delete_by_filter(spark, base):
    left = store.without_matching(_chunks(spark, base), {"page_number": {"$lte": 3}, "config_id": "default"})
    return left.groupBy("config_id").agg(F.count("*").alias("chunks"))


def get_chunks(spark, base):
    keys = table(spark, base, "preprocessing_results").where("page_number is not null").select("document_id").distinct()
    return store.pick(_chunks(spark, base), keys, "document_id").select("id", "document_id", "page_number")


def chunks_by_id(spark, base):
    """The first chunk of each document by its id."""
    keys = _chunks(spark, base).where("document_id is not null").groupBy("document_id").agg(F.min("id").alias("id"))
    return store.pick(_chunks(spark, base), keys).select("id", "document_id")


def delete_chunks(spark, base):
    old = _chunks(spark, base)
    return store.without(old, old.where("length(content) < 50").select("id")).agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"))


def count_chunks(spark, base):
    return _chunks(spark, base).agg(F.count("*").alias("chunks"))


def metadata_filter(spark, base):
    from corpusloom.operators.filters import predicate

    c = table(spark, base, "text_chunks").dropDuplicates(["id"]).withColumnRenamed("source_info", "metadata")
    return c.where(predicate(c, {"author": {"$in": ["vector crew", "archive group"]}, "page_number": {"$gte": 2}})).select("id", "page_number")


def combined_filter(spark, base):
    from corpusloom.operators.filters import content_predicate, predicate

    c = _chunks(spark, base)
    where = {"$or": [{"page_number": {"$gt": 2, "$ne": 5}, "config_id": {"$nin": ["default", "small"]}}, {"chunk_index": {"$lt": 2}}]}
    return c.where(predicate(c, where)).where(content_predicate({"$not_contains": "footnote"})).select("id")


def content_filter(spark, base):
    from corpusloom.operators.filters import content_predicate

    return _chunks(spark, base).where(content_predicate({"$contains": "footnote"})).select("id")


def store_layouts(spark, base):
    """Entries of the merged metadata in a layout where the content wins."""
    c = table(spark, base, "text_chunks").dropDuplicates(["id"]).where("content is not null")
    c = c.select("id", "content", F.col("source_info").alias("metadata"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    return store.as_layout(c, "pinecone").select("id", F.explode("metadata").alias("key", "value")).groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.length("value")).alias("characters")
    )


_MODEL = "text-embedding-3-small"


def cache_misses(spark, base):
    texts = _chunks(spark, base).where("content is not null").select(F.col("content").alias("text"))
    cached = _chunks(spark, base).where("page_number <= 5 and content is not null").select(embedding.cache_key(_MODEL, F.col("content")).alias("key"))
    return embedding.cache_misses(texts, cached, _MODEL).select("key")


def hash_embeddings(spark, base):
    return embedding.embed_texts(table(spark, base, "documents"), embedding.hash_embedder(64), id_col="doc_id")


def end_to_end_search(spark, base):
    """Documents are embedded, and those with an id divisible by 50 look for their nearest."""
    from corpusloom.operators import search

    v = checkpoint(hash_embeddings(spark, base).select(F.col("id").alias("vec_id"), "embedding"))
    return search.search_many(v, v.where(F.col("vec_id") % 50 == 0), 3)


def chunk_embeddings(spark, base):
    """Pages are cut into chunks with their source, and each chunk gets its vector."""
    from corpusloom.plans.text_queries import _S, stored_pages

    c = chunking.page_chunks(stored_pages(spark, base), _S, method="fixed", clean=False)
    e = embedding.embed_chunks(c, embedding.hash_embedder(64), model="hash-64")
    return e.select("id", "document_id", "page_number", "chunk_index", F.md5(F.encode("content", "UTF-8")).alias("hash"), "dimension", "model")


def cached_embeddings(spark, base):
    """All distinct contents with their vectors, and whether each was in the cache or is new to it."""
    texts = _chunks(spark, base).where("content is not null").select(F.col("content").alias("text"))
    held = _chunks(spark, base).where("page_number <= 5 and content is not null").select(embedding.cache_key(_MODEL, F.col("content")).alias("key")).distinct()
    cache = held.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    found, fresh = embedding.cached_embeddings(texts, cache, _MODEL, embedding.hash_embedder(64))
    new = fresh.select("key", F.lit(True).alias("is_new"))
    return found.join(new, "key", "left").select("key", F.size("embedding").alias("dimension"), F.coalesce("is_new", F.lit(False)).alias("is_new"))


def _scratch(spark, name: str) -> str:
    """A new folder in the shared folder of the cluster."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def collection_lifecycle(spark, base):
    """Chunks are stored, changed and deleted in a collection of their own; its final count by page."""
    c = store.Collection(spark, _scratch(spark, "collections"), "chunks")
    rows = _chunks(spark, base).select("id", "document_id", "page_number", "content")
    late = F.col("page_number") == 2
    c.add(rows.where(~F.coalesce(late, F.lit(False))))
    c.add(rows.where(late))
    c.upsert(rows.where("page_number = 1").withColumn("content", F.lit("replaced")))
    c.delete_document("compendium-main")
    c.delete_where({"page_number": {"$gt": 10}})
    c.vacuum()
    return c.read().groupBy("page_number").agg(F.count("*").alias("chunks"), F.count_if(F.col("content") == "replaced").alias("replaced"))


def streaming_ingest(spark, base):
    """The chunk table as a stream, each chunk once, counted by windows of 30 days."""
    root = _scratch(spark, "stream")
    stream = ingest.first_deliveries(ingest.chunk_stream(spark, f"{base}/text_chunks.parquet/*.parquet" if _is_folder(spark, base) else f"{base}/text_chunks*.parquet"))
    out = ingest.run_to_end(stream, ingest.counts_by_month, "w", f"{root}/out", f"{root}/checkpoint")
    return out.select(F.unix_timestamp("w.start").alias("start_s"), "chunks", "characters")


def _is_folder(spark, base) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/text_chunks.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


QUERIES = {
    "document_info": (lambda s, b: documents.document_info(_chunks(s, b).where("document_id is not null")), f"""
        WITH {_ONCE} SELECT document_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS total_characters, count(DISTINCT page_number) AS page_count,
            min(file_name) AS file_name, floor(epoch(min(created_at)))::BIGINT AS created_at_s FROM x WHERE document_id IS NOT NULL GROUP BY document_id"""),
    "list_documents": (lambda s, b: documents.list_documents(_chunks(s, b)), f"""
        WITH {_ONCE} SELECT coalesce(document_id, 'unknown') AS document_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS total_characters,
            round(sum(length(content))::DOUBLE / count(*), 6) AS average_chunk_size FROM x GROUP BY 1"""),
    "documents_page": (lambda s, b: documents.documents_page(_chunks(s, b)), f"""
        WITH {_ONCE} SELECT coalesce(document_id, 'unknown') AS document_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS total_characters,
            round(sum(length(content))::DOUBLE / count(*), 6) AS average_chunk_size FROM x GROUP BY 1 ORDER BY 1 LIMIT 50"""),
    "find_documents": (lambda s, b: documents.find_documents(_chunks(s, b), "RPT-00"), f"""
        WITH {_ONCE} SELECT document_id, count(*) AS chunk_count, sum(length(content))::BIGINT AS total_characters,
            round(sum(length(content))::DOUBLE / count(*), 6) AS average_chunk_size FROM x WHERE contains(lower(document_id), 'rpt-00') GROUP BY 1"""),
    "collection_stats": (lambda s, b: documents.collection_stats(_chunks(s, b)), f"""
        WITH {_ONCE} SELECT count(*) AS chunks, count(DISTINCT document_id) AS documents, sum(length(content))::BIGINT AS characters,
            round(avg(length(content)), 6) AS average_chunk_size FROM x"""),
    "count_chunks": (count_chunks, "SELECT count(DISTINCT id) AS chunks FROM text_chunks"),
    "upsert_result": (upsert_result, f"""
        WITH {_ONCE}, n AS (SELECT id, coalesce(content, '') || ' (revised)' AS content FROM x WHERE page_number = 2)
        SELECT id, md5(content) AS hash FROM x WHERE page_number IS DISTINCT FROM 2 UNION ALL SELECT id, md5(content) FROM n UNION ALL SELECT id || '_x', md5(content) FROM n"""),
    "delete_document_result": (delete_document_result, f"WITH {_ONCE} SELECT document_id, count(*) AS chunks FROM x WHERE document_id IS DISTINCT FROM 'compendium-main' GROUP BY 1"),
    "delete_by_filter": (delete_by_filter, f"""
        WITH {_ONCE} SELECT config_id, count(*) AS chunks FROM x WHERE NOT coalesce(page_number <= 3 AND config_id = 'default', false) GROUP BY 1"""),
    "delete_chunks": (delete_chunks, f"WITH {_ONCE} SELECT count(*) AS chunks, sum(length(content))::BIGINT AS characters FROM x WHERE NOT coalesce(length(content) < 50, false)"),
    "get_chunks": (get_chunks, f"""
        WITH {_ONCE} SELECT id, document_id, page_number FROM x WHERE document_id IN (SELECT document_id FROM preprocessing_results WHERE page_number IS NOT NULL)"""),
    "metadata_filter": (metadata_filter, """
        SELECT DISTINCT id, page_number FROM text_chunks WHERE source_info['author'] IN ('vector crew', 'archive group') AND page_number >= 2"""),
    "combined_filter": (combined_filter, """
        SELECT DISTINCT id FROM text_chunks WHERE ((page_number > 2 AND page_number <> 5 AND config_id NOT IN ('default', 'small')) OR chunk_index < 2)
        AND NOT contains(content, 'footnote')"""),
    "content_filter": (content_filter, "SELECT DISTINCT id FROM text_chunks WHERE contains(content, 'footnote')"),
    "store_layouts": (store_layouts, """
        WITH x AS (SELECT DISTINCT id, content, source_info FROM text_chunks WHERE content IS NOT NULL),
        e AS (SELECT unnest(map_entries(source_info)) AS e FROM x WHERE source_info IS NOT NULL),
        k AS (SELECT e.key AS key, e.value AS value FROM e WHERE e.key <> 'content' UNION ALL SELECT 'content', content FROM x)
        SELECT key, count(*) AS n, sum(length(value))::BIGINT AS characters FROM k GROUP BY key"""),
    "cache_misses": (cache_misses, f"""
        WITH {_ONCE}, k AS (SELECT sha256('{_MODEL}‖' || content) AS key, page_number FROM x WHERE content IS NOT NULL)
        SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE page_number <= 5)"""),
    "cost_estimate": (lambda s, b: embedding.cost_estimate(table(s, b, "documents"), _MODEL), r"""
        WITH t AS (SELECT sum(len(list_filter(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> ''))) AS w, count(*) AS n FROM documents)
        SELECT n AS texts, round((w * 1.3)::DOUBLE, 4) AS tokens, round((w * 1.3)::DOUBLE / 1000 * 0.00002, 8) AS cost FROM t"""),
    "hash_embeddings": (hash_embeddings, None),
    "end_to_end_search": (end_to_end_search, None),
    "processing_summary": (lambda s, b: documents.processing_summary(table(s, b, "processing_results")), """
        WITH r AS (SELECT DISTINCT run_id, document_id, success, chunks_processed AS c, embeddings_generated AS e, chunks_stored AS s,
            CASE WHEN processing_time >= 0 THEN processing_time END AS t FROM processing_results)
        SELECT success, count(*) AS runs, count(DISTINCT document_id) AS documents, sum(c)::BIGINT AS chunks, sum(e)::BIGINT AS embeddings, sum(s)::BIGINT AS stored,
            round(sum(t), 6) AS seconds, round(sum(c) / sum(t), 4) AS chunks_per_second FROM r GROUP BY success"""),
    "collection_lifecycle": (collection_lifecycle, f"""
        WITH {_ONCE} SELECT page_number, count(*) AS chunks, count(*) FILTER (CASE WHEN page_number = 1 THEN true ELSE content = 'replaced' END) AS replaced
        FROM x WHERE document_id IS DISTINCT FROM 'compendium-main' AND NOT coalesce(page_number > 10, false) GROUP BY page_number"""),
    "streaming_ingest": (streaming_ingest, f"""
        WITH {_ONCE} SELECT (epoch(created_at)::BIGINT // 2592000) * 2592000 AS start_s, count(*) AS chunks, coalesce(sum(length(content)), 0)::BIGINT AS characters FROM x
        WHERE created_at IS NOT NULL GROUP BY 1"""),
    "chunks_by_id": (chunks_by_id, f"WITH {_ONCE} SELECT min(id) AS id, document_id FROM x WHERE document_id IS NOT NULL GROUP BY document_id"),
    "chunk_embeddings": (chunk_embeddings, _PAGES + f"""
        SELECT {_PAGE_ID} AS id, document_id, page_number, chunk_index, md5(content) AS hash, 64 AS dimension, 'hash-64' AS model FROM g"""),
    "cached_embeddings": (cached_embeddings, f"""
        WITH {_ONCE}, k AS (SELECT sha256('{_MODEL}‖' || content) AS key, page_number FROM x WHERE content IS NOT NULL), c AS (SELECT DISTINCT key FROM k WHERE page_number <= 5)
        SELECT DISTINCT key, CASE WHEN key IN (SELECT key FROM c) THEN 1 ELSE 64 END AS dimension, key NOT IN (SELECT key FROM c) AS is_new FROM k"""),
}
