"""Problem 9: evaluation texts leaking into training text.

Method: suffix arrays of the training text. The corpus is cut into shards that fit a
task; each shard's word suffixes are sorted, and every suffix of the evaluation items is
found in them by binary search, word by word. A range of suffixes that share the
least number of words is a verbatim match; it is then extended to its full length
and reported with its place in both texts.

Scale: a pass over the corpus for each block of items, without a shuffle of texts. The items, held-out and
small, travel in blocks of a bounded size; more items mean more blocks, not larger
ones, and all items of today's tables are one block. Words that no item has separate the runs of a shard, and only
suffixes that begin with enough item words in a row are sorted, so clean text
costs little more than its tokenization.

Defined results: null, empty or shorter texts match nothing; repeated rows and ties
give one row per document and item; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import words_of
from corpusloom.runtime import spread

#: Characters of items in one block, and words of a shard: both bound a task's memory.
BLOCK_CHARS = 4_000_000
SHARD_WORDS = 1_000_000
_MATCHES = "doc string, item string, doc_word int, item_word int, words int"


class ItemBlock:
    """The word codes of a block of items, laid end to end; code 0 ends an item."""

    def __init__(self, items: list[tuple[str, str]], least: int):
        self.codes: dict[str, int] = {}
        flat, owner, at = [], [], []
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            flat += [self.codes.setdefault(w, len(self.codes) + 1) for w in words] + [0]
            owner += [k] * (len(words) + 1)
            at += range(len(words) + 1)
        self.names = [i for i, _ in items]
        self.flat = np.array(flat + [0] * least, np.int32)
        self.owner, self.at = np.array(owner, np.int32), np.array(at, np.int32)
        self.starts = _live(self.flat, least)


def _live(codes: np.ndarray, least: int) -> np.ndarray:
    """Places where ``least`` known words begin in a row."""
    if len(codes) < least:
        return np.empty(0, np.int64)
    gaps = np.concatenate(([0], np.cumsum(codes == 0)))
    return np.flatnonzero(gaps[least:] == gaps[: len(gaps) - least])


def suffix_array(codes: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the ``depth`` codes from each of them."""
    return places[np.lexsort([codes[places + d] for d in range(depth - 1, -1, -1)])]


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of ``want`` in column[lo:hi], for all searches at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        value = column[np.minimum(mid, len(column) - 1)]
        right = open_ & ((value <= want) if after else (value < want))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def find_suffixes(codes: np.ndarray, ordered: np.ndarray, block: ItemBlock, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The item suffixes that occur in the suffix array, and the range of each there."""
    starts = block.starts
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(ordered), np.int64)
    for d in range(depth):
        column, want = codes[ordered + d], block.flat[starts + d]
        lo, hi = _bound(column, lo, hi, want, False), _bound(column, lo, hi, want, True)
        found = lo < hi
        starts, lo, hi = starts[found], lo[found], hi[found]
        if not len(starts):
            break
    return starts, lo, hi


def _match_shard(flat: list[int], owner: list[int], at: list[int], names: list[str], block: ItemBlock, least: int):
    codes = np.array(flat + [0] * least, np.int32)
    live = _live(codes, least)
    if not len(live) or not len(block.starts):
        return
    ordered = suffix_array(codes, live, least)
    starts, lo, hi = find_suffixes(codes, ordered, block, least)
    if not len(starts):
        return
    item_at = np.repeat(starts, hi - lo)
    offset = np.arange(len(item_at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    doc_at = ordered[np.repeat(lo, hi - lo) + offset]
    before = (item_at > 0) & (doc_at > 0)
    same = before & (block.flat[item_at - 1] == codes[doc_at - 1]) & (codes[doc_at - 1] != 0)
    item_at, doc_at = item_at[~same], doc_at[~same]  # begun further left
    length = np.full(len(item_at), least)
    going = np.arange(len(item_at))
    while len(going):
        a, b = item_at[going] + length[going], doc_at[going] + length[going]
        inside = (a < len(block.flat)) & (b < len(codes))
        going, a, b = going[inside], a[inside], b[inside]
        more = (block.flat[a] == codes[b]) & (codes[b] != 0)
        going = going[more]
        length[going] += 1
    for i, d, n in zip(item_at, doc_at, length):
        yield names[owner[d]], block.names[block.owner[i]], at[d], int(block.at[i]), int(n)


def _matcher(items: list[tuple[str, str]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = ItemBlock(items, least)
        get = block.codes.get
        flat: list[int] = []
        owner: list[int] = []
        at: list[int] = []
        names: list[str] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_match_shard(flat, owner, at, names, block, least))
            for x in (flat, owner, at, names):
                x.clear()
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc", "item", "doc_word", "item_word", "words"]
                )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < least:
                    continue
                codes = [get(w, 0) for w in words]
                flat += codes + [0]
                owner += [len(names)] * (len(codes) + 1)
                at += range(len(codes) + 1)
                names.append(i)
                if len(flat) >= SHARD_WORDS:
                    yield from flush()
        yield from flush()

    return run


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 13,
) -> DataFrame:
    """Left-maximal verbatim matches of at least ``least`` words, with their places and lengths in words."""
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    docs = documents.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    docs = spread(docs)
    parts = []
    for b in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect() if blocks > 1 else tests.collect()
        parts.append(docs.mapInArrow(_matcher([(r.item, r.text) for r in rows], least), _MATCHES))
    return reduce(DataFrame.unionByName, parts)


def without_leaks(documents: DataFrame, passages: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no passage."""
    leaked = passages.select(F.col("doc").alias("_leaked")).distinct()
    return documents.join(leaked, F.col(id_col).cast("string") == F.col("_leaked"), "left_anti")
