"""Queries over the embeddings table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.config import SearchQuery
from corpusloom.operators import documents, embedding_quality, search
from corpusloom.runtime import checkpoint, table


def _vectors(spark, base):
    return table(spark, base, "embeddings")


def _nearest(metric, where=None, min_score=None, n=10):
    def run(spark, base):
        v = _vectors(spark, base)
        q = SearchQuery(tuple(search.stored_vector(v, 0)), n, metric, where, None, min_score)
        return search.search(v, q).select("rank", "vec_id", "label", "score")

    return run


def _sql_nearest(score, where="", outer=""):
    return f"""
        WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
        s AS (SELECT vec_id, label, round({score}, 6) AS score FROM embeddings, q {where}),
        t AS (SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, vec_id) AS rank, vec_id, label, score FROM s)
        SELECT rank, vec_id, label, score FROM t WHERE rank <= 10 {outer}
    """


_COS = "list_cosine_similarity(embedding::DOUBLE[], qv)"
_L2 = "-list_distance(embedding::DOUBLE[], qv)"
_IP = "list_inner_product(embedding::DOUBLE[], qv)"
_CELLS = "cells AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings)"
_DIMS = "dims AS (SELECT dim, avg(v) AS mean, var_pop(v) AS var, max(abs(v)) AS most FROM cells GROUP BY dim)"
_CENTER = "center AS (SELECT list(mean ORDER BY dim) AS c FROM dims)"
_CENTERS = """k AS (SELECT label, dim, avg(v) AS c FROM cells GROUP BY label, dim),
        centers AS (SELECT label, list(c ORDER BY dim) AS c FROM k GROUP BY label)"""


def similar_chunks(spark, base):
    return search.similar(_vectors(spark, base), 5, 10).select("rank", "vec_id", "score")


def metadata_search(spark, base):
    return search.metadata_search(_vectors(spark, base), {"label": {"$gte": 2, "$lte": 4}}, 25, id_col="vec_id").select("vec_id", "label", "score")


def search_many(spark, base):
    v = _vectors(spark, base)
    return search.search_many(v, v.where(F.col("vec_id") % 50 == 0), 5)


def pairwise_similarity_stats(spark, base):
    return embedding_quality.pairwise_cosine(_vectors(spark, base))


def score_bands(spark, base):
    ranked = _nearest("cosine", n=200)(spark, base)
    return ranked.groupBy(documents.score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def embedding_dim_stats(spark, base):
    d = embedding_quality.dimension_stats(_vectors(spark, base))
    return d.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _centers(spark, base):
    return embedding_quality.cluster_centers(_vectors(spark, base))


def label_similarity_matrix(spark, base):
    """Cosine between the centres of the labels, as the nearest of each among all of them."""
    c = checkpoint(_centers(spark, base))
    found = search.search_many(c, c, c.count(), id_col="label", vector_col="center", same_set=False)
    return found.select(F.col("query_id").alias("label_a"), F.col("vec_id").alias("label_b"), F.col("score").alias("cosine"))


def search_between_sets(spark, base):
    """The vectors nearest to the centre of each label."""
    centers = _centers(spark, base).select(F.col("label").alias("vec_id"), F.col("center").alias("embedding"))
    return search.search_many(_vectors(spark, base), centers, 3, same_set=False)


def search_in_document(spark, base):
    """The nearest among the vectors of one document, and of one of its pages."""
    v = _vectors(spark, base).select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("doc"), F.col("label")).alias("document_id"), (F.col("vec_id") % 5).alias("page_number"))
    q = SearchQuery(tuple(search.stored_vector(v, 0, id_col="id")), 5)
    whole = search.similar_within(v, q, document="doc3").withColumn("scope", F.lit("document"))
    page = search.similar_within(v, q, document="doc3", page=2).withColumn("scope", F.lit("page"))
    return whole.unionByName(page).select("scope", "rank", F.col("id").alias("vec_id"), "score")


def _text_pairs(spark, base):
    """Documents and vectors of consecutive ids, in pairs of two: (1, 2), (3, 4), ..."""
    d = table(spark, base, "documents").select(F.col("doc_id").alias("k"), "text")
    v = _vectors(spark, base).select((F.col("vec_id") + 1).alias("k"), F.col("embedding"))
    both = d.join(v, "k").withColumn("pair", F.floor((F.col("k") - 1) / 2)).withColumn("odd", F.col("k") % 2 == 1)
    a = both.where("odd").select("pair", F.col("text").alias("text_a"), F.col("embedding").alias("vec_a"))
    b = both.where("not odd").select("pair", F.col("text").alias("text_b"), F.col("embedding").alias("vec_b"))
    return a.join(b, "pair")


def semantic_consistency(spark, base):
    return embedding_quality.semantic_consistency(_text_pairs(spark, base))


def overall_quality(spark, base):
    return embedding_quality.overall(_vectors(spark, base), pairs=_text_pairs(spark, base))


def quality_recommendations(spark, base):
    """The advice for the vectors, and for the same with half of their dimensions set to zero."""
    v = _vectors(spark, base)
    halved = v.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0.0).cast("float"))))
    out = None
    for name, rows in (("as they are", v), ("halved", halved)):
        advice = embedding_quality.recommendations(embedding_quality.overall(rows), embedding_quality.dimension_utilization(rows)).withColumn("vectors", F.lit(name))
        out = advice if out is None else out.unionByName(advice)
    return out


def kmeans_clusters(spark, base):
    return embedding_quality.clusters(_vectors(spark, base)).groupBy("cluster").agg(F.count("*").alias("n"))


_UTIL = f"""
        WITH {_CELLS}, {_DIMS}, u AS (SELECT count(*) AS dimensions, count(*) FILTER (most = 0) AS zero,
            count(*) FILTER (most < 1e-6) AS near_zero, count(*) FILTER (var < 1e-4) AS low_variance FROM dims)
        SELECT *, round((dimensions - zero - near_zero - low_variance)::DOUBLE / dimensions, 6) AS score FROM u"""
_VARIANCE = f"""
        WITH {_CELLS}, {_DIMS}, t AS (SELECT var_pop(v) AS total FROM cells), m AS (SELECT avg(var) AS mean, stddev_pop(var) AS spread FROM dims)
        SELECT round(total, 6) AS total_variance, round((least(1.0, total / 0.1) + (1 - spread / mean)) / 2, 6) AS score FROM t, m"""
_OUTLIERS = f"""
        WITH {_CELLS}, {_DIMS}, {_CENTER}, d AS (SELECT list_distance(embedding::DOUBLE[], c) AS d FROM embeddings, center),
        q AS (SELECT quantile_cont(d, 0.75) + 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) AS cut FROM d),
        o AS (SELECT count(*) AS count, count(*) FILTER (d > cut) AS outliers, round(max(cut), 6) AS threshold FROM d, q)
        SELECT *, round(greatest(0.0, 1 - 2.0 * outliers / count), 6) AS score FROM o"""
_INTRA = f"""
        WITH {_CELLS}, {_CENTERS}, d AS (SELECT e.label, list_distance(e.embedding::DOUBLE[], c.c) AS d FROM embeddings e JOIN centers c USING (label)),
        p AS (SELECT label, count(*) AS n, avg(d) AS d FROM d GROUP BY label HAVING count(*) > 1)
        SELECT count(*) AS clusters, round(avg(1 / (1 + d)), 6) AS score FROM p"""
_INTER = f"""
        WITH {_CELLS}, {_CENTERS}, p AS (SELECT list_distance(a.c, b.c) AS d FROM centers a JOIN centers b ON a.label < b.label)
        SELECT count(*) AS pairs, round(avg(d), 6) AS mean_distance, round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance,
            round(stddev_pop(d), 6) AS std_distance, round(least(1.0, avg(d) / 2), 6) AS score FROM p"""
_TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({}), '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '')"
_CONSISTENCY = f"""
        WITH x AS (SELECT d.doc_id AS k, text, embedding::DOUBLE[] AS e FROM documents d JOIN embeddings v ON d.doc_id = v.vec_id + 1),
        p AS (SELECT {_TOKENS.format('a.text')} AS s, {_TOKENS.format('b.text')} AS t, list_cosine_similarity(a.e, b.e) AS c
              FROM x a JOIN x b ON b.k = a.k + 1 AND a.k % 2 = 1),
        j AS (SELECT c, CASE WHEN len(s) = 0 OR len(t) = 0 THEN 0.0 ELSE len(list_intersect(s, t))::DOUBLE / len(list_distinct(list_concat(s, t))) END AS j FROM p)
        SELECT count(*) AS pairs, round(1 - avg(abs(j - c)), 6) AS score FROM j"""


def _overall(more: str = "") -> str:
    return f"""
        WITH parts AS (
            SELECT 'dimension_utilization' AS metric, score, 0.2 AS weight FROM ({_UTIL})
            UNION ALL SELECT 'variance', score, 0.15 FROM ({_VARIANCE})
            UNION ALL SELECT 'outliers', score, 0.15 FROM ({_OUTLIERS})
            UNION ALL SELECT 'intra_cluster', score, 0.2 FROM ({_INTRA})
            UNION ALL SELECT 'inter_cluster', score, 0.15 FROM ({_INTER}) {more})
        SELECT metric, score FROM parts
        UNION ALL SELECT 'overall', round((sum(least(1.0, greatest(0.0, score)) * weight) / sum(weight))::DOUBLE, 6) FROM parts"""


_HALVED = """embeddings AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE 0::FLOAT END) AS embedding FROM main.embeddings), """


def _advice(name: str, shadow: str = "") -> str:
    return f"""(WITH {shadow} s AS ({_overall()}), u AS ({_UTIL}), a AS (
        SELECT metric, CASE metric WHEN 'dimension_utilization' THEN 'Consider using a model with better dimension utilization or reducing embedding dimension'
            WHEN 'variance' THEN 'Embeddings show low variance; adjust preprocessing or use a more expressive model'
            WHEN 'outliers' THEN 'High outlier ratio; review input text quality and preprocessing' END AS advice
        FROM s WHERE least(1.0, greatest(0.0, score)) < 0.5 AND metric IN ('dimension_utilization', 'variance', 'outliers')
        UNION ALL SELECT 'zero_dimensions', 'Found ' || zero || ' unused dimensions; consider dimension reduction' FROM u WHERE zero > 0)
        SELECT metric, advice, '{name}' AS vectors FROM a
        UNION ALL SELECT 'overall', 'Embedding quality is good. No major issues detected.', '{name}' WHERE NOT EXISTS (SELECT 1 FROM a))"""


QUERIES = {
    "vector_topk_cosine": (_nearest("cosine"), _sql_nearest(_COS)),
    "vector_topk_l2": (_nearest("l2"), _sql_nearest(_L2)),
    "vector_topk_ip": (_nearest("ip"), _sql_nearest(_IP)),
    "vector_topk_filtered": (_nearest("cosine", {"label": {"$in": [1, 3, 5]}}), _sql_nearest(_COS, "WHERE label IN (1, 3, 5)")),
    "vector_topk_or_filter": (
        _nearest("cosine", {"$or": [{"label": 2}, {"vec_id": {"$lt": 100}}]}), _sql_nearest(_COS, "WHERE label = 2 OR vec_id < 100")
    ),
    "search_threshold": (_nearest("cosine", None, 0.3), _sql_nearest(_COS, "", "AND score >= 0.3")),
    "score_bands": (score_bands, _sql_nearest(_COS).replace("SELECT rank, vec_id, label, score FROM t WHERE rank <= 10", """
        SELECT CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
        FROM t WHERE rank <= 200 GROUP BY 1""")),
    "similar_chunks": (similar_chunks, """
        WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 5),
        s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, q WHERE vec_id <> 5)
        SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""),
    "metadata_search": (metadata_search, "SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE label BETWEEN 2 AND 4 ORDER BY vec_id LIMIT 25"),
    "search_many": (search_many, """
        SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
        FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 5"""),
    "pairwise_similarity_stats": (pairwise_similarity_stats, """
        WITH p AS (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
        SELECT (SELECT count(*) FROM embeddings) AS vectors, round(avg(c), 6) AS mean_cosine, round(stddev_pop(c), 6) AS std_cosine FROM p"""),
    "embedding_norm_stats": (lambda s, b: embedding_quality.norm_stats(_vectors(s, b)), """
        WITH n AS (SELECT sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, len(embedding) AS d FROM embeddings)
        SELECT count(*) AS count, max(d) AS dimension, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm,
            round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm FROM n"""),
    "embedding_dim_stats": (embedding_dim_stats, f"WITH {_CELLS} SELECT dim - 1 AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cells GROUP BY dim"),
    "dim_utilization": (lambda s, b: embedding_quality.dimension_utilization(_vectors(s, b)), _UTIL),
    "variance_score": (lambda s, b: embedding_quality.variance_score(_vectors(s, b)), _VARIANCE),
    "outliers": (lambda s, b: embedding_quality.outliers(_vectors(s, b)), _OUTLIERS),
    "intra_cluster": (lambda s, b: embedding_quality.intra_cluster(_vectors(s, b)), _INTRA),
    "inter_cluster": (lambda s, b: embedding_quality.inter_cluster(_vectors(s, b)), _INTER),
    "label_similarity_matrix": (label_similarity_matrix, f"""
        WITH {_CELLS}, {_CENTERS}
        SELECT a.label AS label_a, b.label AS label_b, round(list_cosine_similarity(a.c::FLOAT[]::DOUBLE[], b.c::FLOAT[]::DOUBLE[]), 6) AS cosine FROM centers a, centers b"""),
    "semantic_consistency": (semantic_consistency, _CONSISTENCY),
    "search_between_sets": (search_between_sets, f"""
        WITH {_CELLS}, {_CENTERS}, s AS (SELECT c.label AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c.c::FLOAT[]::DOUBLE[]), 6) AS score FROM embeddings e, centers c)
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 3"""),
    "search_in_document": (search_in_document, f"""
        WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
        s AS (SELECT vec_id, vec_id % 5 = 2 AS here, round({_COS}, 6) AS score FROM embeddings, q WHERE label = 3)
        (SELECT 'document' AS scope, row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 5)
        UNION ALL (SELECT 'page', row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s WHERE here QUALIFY rank <= 5)"""),
    "overall_quality": (overall_quality, _overall(f"UNION ALL SELECT 'semantic_consistency', score, 0.15 FROM ({_CONSISTENCY})")),
    "quality_recommendations": (quality_recommendations, f"{_advice('as they are')} UNION ALL {_advice('halved', _HALVED)}"),
    "kmeans_clusters": (kmeans_clusters, None),
}
