"""Problem 1: near-duplicate records with small edits.

Method: fast similarity sketching. Every record's word shingles are thrown into
``bins`` hashed bins, round after round, until each bin is filled; bin ``k``
keeps the smallest value, so two records agree in a bin with a probability equal to
the Jaccard similarity of their shingle sets, and the bins are concentrated as if
independent. Runs of ``rows`` bins are hashed into bands; records that share a
band are candidates; candidates are verified exactly on their shingle sets.

Scale: equal word sequences are one class, and a task emits the bands of a class once,
so a hot group of copies costs a few rows; the bands' partitions grow in number with
them. Bands that many classes share are told by a sample of the classes by their hash, which changes no result, and cut
into blocks that meet two by two (``pairs.py``), so that no task holds a hot band; copies of
a hot class are paired in the same way. Shingles never leave a task, and whole texts travel
only for the verification of candidates.

Defined results: a null, empty or shorter text than ``min_words`` has no class (null) and
no partner; repeated rows of one id count once; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import pairs
from corpusloom.llm.words import WordHasher, mix, shingle_hashes, words_of
from corpusloom.runtime import broadcast_if_small, checkpoint, spread

_LOW = np.uint64((1 << 48) - 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_FEW = 256  # records sketched together
_SEEN = 1_000_000  # classes a task remembers; forgetting them costs repeated bands, no result
_ROWS = 250_000  # bands in a partition
_SIEVE = 32  # one class in so many is looked at for hot bands


def fast_similarity_sketch(hashes: np.ndarray, owner: np.ndarray, count: int, bins: int) -> np.ndarray:
    """Sketches of ``count`` records, given the shingle hashes and the record of each, as a matrix."""
    sketch = np.full(count * bins, _EMPTY, np.uint64)
    live_h, live_o = hashes, owner
    for turn in range(2 * bins):
        x = mix(live_h + np.uint64((turn * 0x632BE59BD9B4E019 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
        if turn < bins:
            bin_of = ((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        else:
            bin_of = np.full(len(x), turn - bins, np.uint64)
        value = (np.uint64(turn) << np.uint64(48)) | (mix(x) & _LOW)
        np.minimum.at(sketch, live_o * bins + bin_of.astype(np.int64), value)
        open_ = (sketch.reshape(count, bins) == _EMPTY).any(axis=1)
        keep = open_[live_o]
        if not keep.any():
            break
        live_h, live_o = live_h[keep], live_o[keep]
    return sketch.reshape(count, bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` bins; the run's place is part of the key."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * np.uint64(31) + parts[:, :, r])
    return key.view(np.int64)


def _sketcher(width: int, min_words: int, rows: int, bands: int):
    bins = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            all_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), _FEW):
                ids, classes, flat, sizes, without = [], [], [], [], []
                for i, text in zip(all_ids[at : at + _FEW], texts[at : at + _FEW]):
                    words = words_of(text)
                    if len(words) < min_words:
                        without.append(i)
                        continue
                    ids.append(i)
                    classes.append(xxhash.xxh3_128_digest(" ".join(words)))
                    flat += hasher(words)
                    sizes.append(len(words))
                if without:
                    none = [pa.nulls(len(without), t) for t in (pa.binary(), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array(without, pa.string()), *none], ["id", "class_key", "bands"])
                if not ids:
                    continue
                owner = np.repeat(np.arange(len(ids)), sizes)
                h, o = shingle_hashes(np.array(flat, np.uint64), owner, width)
                fresh = []
                if len(seen) > _SEEN:
                    seen.clear()
                for key in classes:
                    fresh.append(key not in seen)
                    seen.add(key)
                keys = band_keys(fast_similarity_sketch(h, o, len(ids), bins), rows)
                column = pa.array([k if new else None for k, new in zip(keys, fresh)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(classes, pa.binary()), column], ["id", "class_key", "bands"]
                )

    return run


def _exact(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            memo: dict[bytes, frozenset] = {}

            def shingles(key: bytes, text: str) -> frozenset:
                if key not in memo:
                    w = words_of(text)
                    memo[key] = frozenset(zip(*(w[k:] for k in range(width))))
                return memo[key]

            keep, score = [], []
            for k in range(len(a)):
                x, y = shingles(a[k], ta[k]), shingles(b[k], tb[k])
                common = len(x & y)
                union = len(x) + len(y) - common
                if union and common >= threshold * union - 1e-9:
                    keep.append(k)
                    score.append(common / union)
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a[k] for k in keep], pa.binary()), pa.array([b[k] for k in keep], pa.binary()), pa.array(score)],
                    ["class_a", "class_b", "similarity"],
                )

    return run


def near_duplicates(
    records: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "content",
    width: int = 5,
    threshold: float = 0.8,
    min_words: int = 20,
    rows: int = 4,
    bands: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences and the verified links between classes.

    Returns ``members(id, class_key)`` of all ids and ``links(class_a, class_b, similarity)``
    with ``class_a < class_b``. The defaults suit five-word shingles at 0.8;
    the chance to miss a pair of similarity ``s`` is ``(1 - s**rows)**bands``.
    """
    src = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    sketched = checkpoint(
        spread(src).mapInArrow(_sketcher(width, max(min_words, width), rows, bands), "id string, class_key binary, bands array<bigint>")
    )
    members = sketched.select("id", "class_key").distinct()
    # 64 bits stand for the class in the bands; the full key comes back with the text.
    short = F.xxhash64("class_key")
    banded = sketched.select(short.alias("short"), F.explode("bands").alias("band"))
    sieved = banded.where(F.pmod("short", F.lit(_SIEVE)) == 0).groupBy("band").agg((F.lit(_SIEVE) * F.count_distinct("short")).alias("n"))
    hot = checkpoint(pairs.hot_groups(sieved, "band"))
    partitions = max(sketched.sparkSession.sparkContext.defaultParallelism, sketched.where("bands is not null").count() * bands // _ROWS)
    # the cell is part of the key: a clash of hashes only adds candidates, which are checked, and keys stay short
    key = F.when(F.col("cell") == 0, F.col("band")).otherwise(F.xxhash64("band", "cell")).alias("key")
    celled = pairs.in_cells(banded, "band", "short", hot).select(key, "short").repartition(partitions, "key").dropDuplicates(["key", "short"])
    candidates = checkpoint(
        celled.toDF("key", "short_a").join(celled.toDF("key", "short_b").hint("merge"), "key")
        .where("short_a < short_b").select("short_a", "short_b").distinct()
    )
    wanted = checkpoint(candidates.select(F.explode(F.array("short_a", "short_b")).alias("short")).distinct())
    chosen = checkpoint(
        sketched.select("id", "class_key", short.alias("short"))
        .join(broadcast_if_small(wanted), "short")
        .groupBy("short", "class_key")
        .agg(F.min("id").alias("id"))
    )
    texts = checkpoint(
        src.where(F.col("id").isNotNull())
        .join(broadcast_if_small(chosen), "id")
        .dropDuplicates(["class_key"])
        .select("short", "class_key", "text")
    )
    links = (
        candidates.join(texts.toDF("short_a", "key_a", "text_a"), "short_a")
        .join(texts.toDF("short_b", "key_b", "text_b"), "short_b")
        .select(
            F.least("key_a", "key_b").alias("class_a"),
            F.greatest("key_a", "key_b").alias("class_b"),
            F.when(F.col("key_a") < F.col("key_b"), F.col("text_a")).otherwise(F.col("text_b")).alias("text_a"),
            F.when(F.col("key_a") < F.col("key_b"), F.col("text_b")).otherwise(F.col("text_a")).alias("text_b"),
        )
        .mapInArrow(_exact(width, threshold), "class_a binary, class_b binary, similarity double")
    )
    return members, links


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of ids in linked classes or in one class, smaller id first."""
    members = members.where("id is not null and class_key is not null")
    a, b = members.toDF("id_x", "class_a"), members.toDF("id_y", "class_b")
    across = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("id_x", "id_y")
    sizes = checkpoint(members.groupBy("class_key").agg(F.count("*").alias("n")).where("n > 1"))
    copies = pairs.in_cells(members.join(broadcast_if_small(sizes.select("class_key")), "class_key"), "class_key", "id", pairs.hot_groups(sizes, "class_key"))
    within = pairs.cell_pairs(copies, "class_key", "id").select(F.col("id_a").alias("id_x"), F.col("id_b").alias("id_y"))
    return across.unionByName(within).select(
        F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")
    ).distinct()


def components(links: DataFrame) -> DataFrame:
    """(class_key, root): the smallest class of each connected group of links.

    Labels spread along links and then jump to the label of their label, so the rounds
    grow with the logarithm of a group's diameter; each round is checkpointed.
    """
    edges = checkpoint(
        links.select(F.explode(F.array(F.struct("class_a", "class_b"), F.struct(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))).alias("e"))
        .select(F.col("e.class_a").alias("class_key"), F.col("e.class_b").alias("other"))
        .distinct()
    )
    labels = checkpoint(edges.groupBy("class_key").agg(F.least(F.min("other"), F.first("class_key")).alias("root")))
    while True:
        near = edges.join(labels.toDF("other", "root"), "other").groupBy("class_key").agg(F.min("root").alias("near"))
        spread = labels.join(near, "class_key").select("class_key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.toDF("at", "far")
        after = checkpoint(
            spread.join(jump, spread["root"] == jump["at"], "left").select("class_key", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        )
        labels = after.select("class_key", "root")
        if after.where("old <> root").limit(1).count() == 0:
            return labels


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, group_id, links): one row for each record; those too short for a class have neither it nor links.

    ``class_id`` is that of its word sequence, ``group_id`` that of all classes it is
    linked to, directly or through others; ``links`` counts the other records linked to it.
    """
    sizes = members.where("class_key is not null").groupBy("class_key").agg(F.count("*").alias("n"))
    ends = links.select("class_a", "class_b").unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    degree = ends.join(sizes.toDF("class_b", "m"), "class_b").groupBy("class_a").agg(F.sum("m").alias("m")).withColumnRenamed("class_a", "class_key")
    per_class = (
        sizes.join(degree, "class_key", "left").join(components(links), "class_key", "left")
        .select("class_key", F.hex("class_key").alias("class_id"), F.hex(F.coalesce("root", "class_key")).alias("group_id"),
                (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    )
    return members.join(per_class, "class_key", "left").select("id", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
