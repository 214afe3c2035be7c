"""Problem 2: splitting oversized items at natural boundaries.

Method: pointer doubling. All natural boundaries of a text are found first; each is
joined, by binary search, to its farthest legal successor: the next piece may begin
up to ``chunk_overlap`` characters before the cut and ends at the farthest boundary
of the best kind within ``chunk_size``. The successor table is then squared again
and again; after ``k`` squarings all cuts up to ``2**k`` pieces from the start are
known, so no text is walked cut by cut. The tables of all texts of an Arrow batch
are flat NumPy arrays, worked on together.

Scale: a map over the rows, without a shuffle; only oversized texts leave the JVM,
and the configs, a small table, are joined by a size-checked broadcast.

Defined results: a null text has no piece; an empty text or one within the limit is
one whole piece; a null or unknown config is ``default``; repeated rows give repeated
pieces; a text without any boundary is cut hard, within the limit; an overlap of the
size or more counts as the size less one. Pieces joined without their overlaps give
back the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small

_SPACE = re.compile(r"\s+")
_SENTENCE_ENDS = ".!?…。！？"
_CLOSERS = "\"'”’»)]"
_CHARS = 2_000_000  # characters whose tables are worked on together
_PIECES = "id string, piece_index int, start_char int, end_char int, piece string"


def boundaries(text: str, separators: list[str]) -> tuple[list[int], list[float]]:
    """Places where a piece may end, each after white space, and their ranks.

    The rank of a place is that of the first separator it holds, earlier ones being
    better; an end of sentence ranks just above a plain space.
    """
    ranked = [(s, float(len(separators) - k)) for k, s in enumerate(separators) if s]
    plain = next((r for s, r in ranked if s == " "), 1.0)
    places, ranks = [], []
    for m in _SPACE.finditer(text):
        run, at = m.group(), m.start()
        rank = next((r for s, r in ranked if s in run), plain)
        if rank <= plain:
            k = at - 1
            while k > 0 and text[k] in _CLOSERS:
                k -= 1
            if k >= 0 and text[k] in _SENTENCE_ENDS:
                rank = plain + 0.5
        places.append(m.end())
        ranks.append(rank)
    return places, ranks


def cuts(texts: list[str], sizes: list[int], overlaps: list[int], separators: list[list[str]]) -> list[list[tuple[int, int]]]:
    """The pieces of each text, as (start, end)."""
    place, rank, owner = [], [], []
    for k, text in enumerate(texts):
        p, r = boundaries(text, separators[k])
        known = dict(zip(p, r)) | {0: 99.0, len(text): 99.0}
        ordered = sorted(known)
        gap = max(1, sizes[k] - overlaps[k])
        for a, b in zip(ordered, ordered[1:]):  # too far apart: forced places between them
            if b - a > gap:
                known |= dict.fromkeys(range(a + gap, b, gap), 0.0)
        ordered = sorted(known)
        place.append(np.array(ordered, np.int64))
        rank.append(np.array([known[x] for x in ordered]))
        owner.append(np.full(len(ordered), k))
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    owner = np.concatenate(owner)
    at, rank = np.concatenate(place) + base[owner], np.concatenate(rank)
    size, overlap = np.array(sizes)[owner], np.array(overlaps)[owner]
    final = base[owner] + np.array([len(t) for t in texts])[owner]

    first = at == base[owner]
    start = np.where(first, at, at[np.searchsorted(at, np.maximum(base[owner], at - overlap))])
    limit = np.minimum(start + size, final)
    successor = np.full(len(at), -1)
    for level in np.unique(rank)[::-1]:
        good = np.flatnonzero(rank >= level)
        found = good[np.searchsorted(at[good], limit, "right") - 1]
        far = (at[found] > at) & ((at[found] - start) * 2 >= size)
        successor = np.where((successor < 0) & far, found, successor)
    nearest = np.searchsorted(at, limit, "right") - 1
    successor = np.where(successor < 0, nearest, successor)
    ends = np.searchsorted(at, final)
    successor = np.where(limit >= final, ends, successor)

    reached, hop = first.copy(), successor
    while True:
        more = hop[np.flatnonzero(reached)]
        if reached[more].all():
            break
        reached[more] = True
        hop = hop[hop]  # squared: twice as far

    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k in np.flatnonzero(reached & (at < final)):
        o = owner[k]
        out[o].append((int(start[k] - base[o]), int(at[successor[k]] - base[o])))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        while rows:
            some, chars = [], 0
            while rows and (not some or chars < _CHARS):
                some.append(rows.pop())
                chars += len(some[-1][1])
            ids, texts, sizes, overlaps, separators = zip(*some)
            sizes = [max(1, s) for s in sizes]
            overlaps = [min(max(0, o or 0), s - 1) for o, s in zip(overlaps, sizes)]
            found = cuts(list(texts), sizes, overlaps, [x or [" "] for x in separators])
            flat = [(i, n, a, b, t[a:b]) for i, t, pieces in zip(ids, texts, found) for n, (a, b) in enumerate(pieces)]
            names = ["id", "piece_index", "start_char", "end_char", "piece"]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), kinds)], names)


def with_limits(items: DataFrame, configs: DataFrame, *, id_col: str = "id", text_col: str = "content", config_col: str = "config_id") -> DataFrame:
    """Each item as (id, text, size, overlap, separators), with the limits of its config."""
    limits = configs.select(
        F.col("config_id").alias("name"), F.col("chunk_size").alias("size"), F.col("chunk_overlap").alias("overlap"), "separators"
    ).dropDuplicates(["name"])
    usual = limits.where("name = 'default'").select("size", "overlap", "separators").collect()  # one row, as names are unique
    size, overlap, separators = usual[0] if usual else (None, None, None)
    parts = F.lit(None).cast("array<string>") if separators is None else F.array(*[F.lit(x) for x in separators]).cast("array<string>")
    named = items.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(config_col, F.lit("default")).alias("name")
    )
    return named.join(broadcast_if_small(limits), "name", "left").select(
        "id", "text",
        F.coalesce("size", F.lit(size).cast("int")).alias("size"),
        F.coalesce("overlap", F.lit(overlap).cast("int")).alias("overlap"),
        F.coalesce("separators", parts).alias("separators"),
    )


def split_oversized(limited: DataFrame) -> DataFrame:
    """Pieces of the items whose text is longer than their limit."""
    return limited.where(F.length("text") > F.col("size")).mapInArrow(_split, _PIECES)


def all_pieces(limited: DataFrame) -> DataFrame:
    """Pieces of all items; one within its limit is a single piece."""
    whole = limited.where((F.length("text") <= F.col("size")) | F.col("size").isNull()).where("text is not null")
    return whole.select(
        "id", F.lit(0).alias("piece_index"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.col("text").alias("piece")
    ).unionByName(split_oversized(limited))
