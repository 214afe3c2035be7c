"""Quality of a set of embeddings, as aggregates.

Everything but the extremes of pairwise similarity needs one pass over vectors or cells;
mean and deviation of all pairwise cosines come from the Gram matrix of the
dimensions, so they cost n * d * d, not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vector as V
from corpusloom.functions.text import tokens
from corpusloom.runtime import checkpoint

# Weights of the metrics in the overall score.
WEIGHTS = {"dimension_utilization": 0.2, "variance": 0.15, "outliers": 0.15, "intra_cluster": 0.2, "inter_cluster": 0.15, "semantic_consistency": 0.15}

# What to do about a low score.
ADVICE = {
    "dimension_utilization": "Consider using a model with better dimension utilization or reducing embedding dimension",
    "variance": "Embeddings show low variance; adjust preprocessing or use a more expressive model",
    "outliers": "High outlier ratio; review input text quality and preprocessing",
    "semantic_consistency": "Low semantic consistency; consider fine-tuning or improved preprocessing",
}

#: Values that a step of a quantile search takes to the driver, and classes it counts.
QUANTILE_VALUES, QUANTILE_CLASSES = 10_000, 1024
#: Clusters whose centres may be sent to the tasks.
MAX_CLUSTERS = 10_000


def cells(vectors: DataFrame, *keep: str, vector_col: str = "embedding") -> DataFrame:
    return vectors.select(*keep, F.posexplode(vector_col).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def norm_stats(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    n = V.norm(F.col(vector_col))
    return vectors.agg(
        F.count("*").alias("count"), F.max(F.size(vector_col)).alias("dimension"),
        F.round(F.avg(n), 6).alias("mean_norm"), F.round(F.stddev_pop(n), 6).alias("std_norm"),
        F.round(F.min(n), 6).alias("min_norm"), F.round(F.max(n), 6).alias("max_norm"),
    )


def dimension_stats(vectors: DataFrame) -> DataFrame:
    return cells(vectors).groupBy("dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.var_pop("v").alias("var"), F.max(F.abs("v")).alias("most")
    )


def dimension_utilization(vectors: DataFrame) -> DataFrame:
    """Share of used dimensions; a zero dimension counts in all three subtractions."""
    d = dimension_stats(vectors)
    return d.agg(
        F.count("*").alias("dimensions"), F.count_if(F.col("most") == 0).alias("zero"), F.count_if(F.col("most") < 1e-6).alias("near_zero"),
        F.count_if(F.col("var") < 1e-4).alias("low_variance"),
    ).withColumn("score", F.round((F.col("dimensions") - F.col("zero") - F.col("near_zero") - F.col("low_variance")) / F.col("dimensions"), 6))


def variance_score(vectors: DataFrame) -> DataFrame:
    per = cells(vectors).groupBy("dim").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.var_pop("v").alias("var"))
    total = F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)
    return per.agg(total.alias("total"), F.avg("var").alias("mean"), F.stddev_pop("var").alias("spread")).select(
        F.round("total", 6).alias("total_variance"),
        F.round((F.least(F.lit(1.0), F.col("total") / 0.1) + (1 - F.col("spread") / F.col("mean"))) / 2, 6).alias("score"),
    )


def centroid_distances(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Distance of every vector to the centre of all; the centre, one row a dimension, is collected into one array."""
    center = cells(vectors).groupBy("dim").agg(F.avg("v").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda x: x["c"]).alias("center"))
    return vectors.withColumn("one", F.lit(1)).join(F.broadcast(center.withColumn("one", F.lit(1))), "one").select(
        id_col, V.l2(F.col("embedding"), F.col("center")).alias("distance")
    )


def exact_quantiles(values: DataFrame, column: str, shares: list[float], *, few: int = QUANTILE_VALUES) -> list[float] | None:
    """Quantiles with linear interpolation, as if all values were sorted; null without values.

    The range that holds the wanted ranks is cut into classes and counted again, until few values are left in it; ``values``
    should be checkpointed, as it is read a few times.
    """
    v = F.col(column).cast("double")
    rows = values.select(v.alias("v")).where("v is not null and not isnan(v)")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None

    def at_rank(rank: int) -> float:
        a, b, before = low, high, 0
        while a < b:
            inside = rows.where((F.col("v") >= a) & (F.col("v") <= b))
            first = inside.limit(few + 1).collect()
            if len(first) <= few:
                return sorted(r.v for r in first)[rank - before]
            width = (b - a) / QUANTILE_CLASSES
            kind = F.least(F.floor((F.col("v") - a) / width), F.lit(QUANTILE_CLASSES - 1))
            counts = inside.groupBy(kind.alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k").collect()
            for r in counts:
                if before + r.n > rank:
                    a, b = r.a, r.b
                    break
                before += r.n
        return a

    out = []
    for share in shares:
        place = (n - 1) * share
        k = int(place)
        x = at_rank(k)
        out.append(x if place == k else x + (at_rank(k + 1) - x) * (place - k))
    return out


def outliers(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    d = checkpoint(centroid_distances(vectors, id_col))
    quartiles = exact_quantiles(d, "distance", [0.25, 0.75])
    cut = F.lit(None if quartiles is None else quartiles[1] + 1.5 * (quartiles[1] - quartiles[0])).cast("double")
    return d.agg(
        F.count("*").alias("count"), F.count_if(F.col("distance") > cut).alias("outliers"), F.round(F.max(cut), 6).alias("threshold")
    ).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - 2 * F.col("outliers") / F.col("count")), 6))


def cluster_centers(vectors: DataFrame, cluster_col: str = "label") -> DataFrame:
    per = cells(vectors, cluster_col).groupBy(cluster_col, "dim").agg(F.avg("v").alias("c"))
    return per.groupBy(cluster_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda x: x["c"]).alias("center"))


def intra_cluster(vectors: DataFrame, cluster_col: str = "label") -> DataFrame:
    """Mean over clusters of two or more of 1 / (1 + mean distance to the centre)."""
    d = vectors.join(cluster_centers(vectors, cluster_col), cluster_col).select(cluster_col, V.l2(F.col("embedding"), F.col("center")).alias("d"))
    per = d.groupBy(cluster_col).agg(F.count("*").alias("n"), F.avg("d").alias("d")).where("n > 1")
    return per.agg(F.count("*").alias("clusters"), F.round(F.avg(1 / (1 + F.col("d"))), 6).alias("score"))


def _center_pairs(centers: np.ndarray):
    """Count, sum, sum of squares, least and largest distance of a task's centres to those after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                d = np.linalg.norm(centers[at + 1 :] - centers[at], axis=1)
                if len(d):
                    columns = [[len(d)], [d.sum()], [(d * d).sum()], [d.min()], [d.max()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["n", "s", "ss", "least", "most"])

    return run


def inter_cluster(vectors: DataFrame, cluster_col: str = "label") -> DataFrame:
    """Distances between centres, each pair once; more than ``MAX_CLUSTERS`` centres are refused."""
    spark = vectors.sparkSession
    rows = cluster_centers(vectors, cluster_col).orderBy(cluster_col).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    parts = spark.range(len(rows)).mapInArrow(_center_pairs(np.array([r["center"] for r in rows], float)), "n double, s double, ss double, least double, most double")
    mean = F.col("s") / F.col("n")
    return parts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("least").alias("least"), F.max("most").alias("most")).select(
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("pairs"), F.round(mean, 6).alias("mean_distance"), F.round("least", 6).alias("min_distance"),
        F.round("most", 6).alias("max_distance"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)), 6).alias("std_distance"),
        F.round(F.least(F.lit(1.0), mean / 2), 6).alias("score"),
    )


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the task's vectors at unit length: their number, their sum and the products of all pairs of dimensions, by place."""
    total, n = None, 0
    for batch in batches:
        kept = batch.column(0).drop_null()
        if not len(kept):
            continue
        u = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(kept), -1)
        size = np.linalg.norm(u, axis=1)
        u = u[size > 0] / size[size > 0, None]
        n += len(u)
        part = np.concatenate([u.sum(axis=0)[None, :], u.T @ u])
        total = part if total is None else total + part
    if total is not None:
        flat = np.concatenate([[n], total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat), pa.array([total.shape[1]] * len(flat), pa.int64())], ["place", "p", "d"])


def pairwise_cosine(vectors: DataFrame) -> DataFrame:
    """Mean and deviation of the cosine of all pairs, exactly, from one pass that sums dimensions and products of dimensions."""
    summed = vectors.select("embedding").mapInArrow(_gram, "place bigint, p double, d bigint").groupBy("place").agg(F.sum("p").alias("p"), F.max("d").alias("d"))
    square = F.col("p") * F.col("p")
    n, first, second = (F.sum(F.when(c, x)) for c, x in (
        (F.col("place") == 0, F.col("p")), ((F.col("place") > 0) & (F.col("place") <= F.col("d")), square), (F.col("place") > F.col("d"), square),
    ))
    sums = summed.agg(n.alias("n"), first.alias("first"), second.alias("second"))
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("first") - F.col("n")) / pairs
    return sums.select(
        F.coalesce("n", F.lit(0)).cast("bigint").alias("vectors"), F.round(mean, 6).alias("mean_cosine"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), (F.col("second") - F.col("n")) / pairs - mean * mean)), 6).alias("std_cosine"),
    )


def semantic_consistency(pairs: DataFrame) -> DataFrame:
    """1 - mean |token overlap - cosine| over rows of (text_a, text_b, vec_a, vec_b)."""
    words = [F.transform(tokens(F.lower(c)), lambda t: t) for c in ("text_a", "text_b")]
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.round(1 - F.avg(F.abs(V.jaccard(words[0], words[1]) - V.cosine(F.col("vec_a"), F.col("vec_b")))), 6).alias("score"),
    )


def overall(vectors: DataFrame, cluster_col: str = "label", *, pairs: DataFrame | None = None) -> DataFrame:
    """(metric, score) of each metric and of their weighted mean; ``pairs`` of texts and vectors add their consistency."""
    parts = {
        "dimension_utilization": dimension_utilization(vectors), "variance": variance_score(vectors), "outliers": outliers(vectors),
        "intra_cluster": intra_cluster(vectors, cluster_col), "inter_cluster": inter_cluster(vectors, cluster_col),
    }
    if pairs is not None:
        parts["semantic_consistency"] = semantic_consistency(pairs)
    rows = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("metric"), F.col("score"), F.lit(WEIGHTS[name]).alias("weight"))
        rows = row if rows is None else rows.unionByName(row)
    rows = checkpoint(rows)  # a row for each metric
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    total = rows.agg(F.lit("overall").alias("metric"), F.round(F.sum(clamped * F.col("weight")) / F.sum("weight"), 6).alias("score"))
    return rows.select("metric", "score").unionByName(total)


def recommendations(scores: DataFrame, utilization: DataFrame | None = None) -> DataFrame:
    """(metric, advice): what to do about scores below one half, and about unused dimensions (``utilization`` has their number ``zero``); that all is well, if so."""
    table = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    advice = scores.where(clamped < 0.5).select("metric", F.element_at(table, F.col("metric")).alias("advice")).where("advice is not null")
    if utilization is not None:
        text = F.format_string("Found %d unused dimensions; consider dimension reduction", F.col("zero"))
        advice = advice.unionByName(utilization.where("zero > 0").select(F.lit("zero_dimensions").alias("metric"), text.alias("advice")))
    advice = checkpoint(advice)
    good = advice.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("overall").alias("metric"), F.lit("Embedding quality is good. No major issues detected.").alias("advice"))
    return advice.unionByName(good)


def clusters(vectors: DataFrame, seed: int = 42) -> DataFrame:
    """k-means with a k that follows the number of vectors; fewer than ten are all in cluster 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if n < 10:
        return vectors.select("vec_id", F.lit(0).alias("cluster"))
    k = min(10, max(2, n // 20))
    ready = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(ready).transform(ready).select("vec_id", F.col("prediction").alias("cluster"))
