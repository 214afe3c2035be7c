"""Problem 8: filling fixed-capacity containers with items.

Method: large-item matching. Items above a third of the capacity come at most in pairs:
each, from the largest down, is matched with the largest other that still fits. The
smaller items, from the largest down, go where they leave the least gap (best fit).
Only an item that exceeds the capacity alone is cut, into full pieces and a rest.

Items of one size are interchangeable, so the matching runs on the histogram of sizes,
of at most ``capacity`` rows whatever the corpus, and yields patterns ("7 containers with
one of 300 and two of 106"). Items are then numbered within their size by the tasks
and joined to the slots of their size.

Scale: the texts are tokenized in one map; then only (id, size) is shuffled, by range, so
that a size a third of all items share is spread over tasks. The containers of each
capacity are matched in a task of their own, in time that grows with its histogram. The slots of a size are ranges of ranks, of very
different lengths; ranks are cut into stretches as long as its mean slot, on which items and
slots are joined, so an item meets three slots at most on average and a hot size
has many keys.

Defined results: null and empty texts have no tokens and no container; repeated rows of one
id are packed once; a missing capacity or one below 1 is refused, as are more than 1,000 container sizes; ties in size go by id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, checkpoint, collect_small, shuffle_partitions, spread

#: A public tokenizer's vocabulary file; it must be readable on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_FEW = 64  # texts tokenized together
_STRETCH = 65_536  # longest stretch of ranks that is one key of the join


def token_counts(records: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        t.no_truncation()
        encode = getattr(t, "encode_batch_fast", t.encode_batch)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            sizes: list[int] = []
            for at in range(0, len(texts), _FEW):
                sizes += [len(e.ids) for e in encode(texts[at : at + _FEW], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "tokens"])

    src = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(run, "id bigint, tokens bigint")


class Pattern:
    """``count`` containers that hold the same sizes, (size, how many) each, with ``gap`` left."""

    __slots__ = ("count", "gap", "last", "before")

    def __init__(self, count: int, gap: int, last: tuple[int, int], before: Pattern | None = None):
        self.count, self.gap, self.last, self.before = count, gap, last, before

    @property
    def sizes(self) -> list[tuple[int, int]]:
        out, p = [], self
        while p:
            out.append(p.last)
            p = p.before
        return out[::-1]


class Numbers:
    """A set of numbers up to a limit, with the least one from a number on, by words of bits."""

    def __init__(self, limit: int):
        self.words, self.used = [0] * ((limit >> 10) + 1), 0

    def add(self, x: int) -> None:
        self.words[x >> 10] |= 1 << (x & 1023)
        self.used |= 1 << (x >> 10)

    def remove(self, x: int) -> None:
        self.words[x >> 10] &= ~(1 << (x & 1023))
        if not self.words[x >> 10]:
            self.used &= ~(1 << (x >> 10))

    def least_from(self, x: int) -> int | None:
        w = x >> 10
        here = self.words[w] >> (x & 1023)
        if here:
            return x + (here & -here).bit_length() - 1
        above = self.used >> (w + 1)
        if not above:
            return None
        w += (above & -above).bit_length()
        return (w << 10) + (self.words[w] & -self.words[w]).bit_length() - 1


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold all items of a histogram of sizes, each at most ``capacity``."""
    left = {s: n for s, n in histogram.items() if n and s}
    done: list[Pattern] = []
    open_: dict[int, list[Pattern]] = {}
    gaps = Numbers(capacity)

    def add(count: int, gap: int, last: tuple[int, int], before: Pattern | None = None) -> None:
        put(Pattern(count, gap, last, before))

    def put(p: Pattern) -> None:
        if p.count <= 0:
            return
        if p.gap == 0:
            done.append(p)
            return
        if not open_.get(p.gap):
            open_[p.gap] = []
            gaps.add(p.gap)
        open_[p.gap].append(p)

    large = sorted(s for s in left if 3 * s > capacity)
    under = list(range(len(large)))  # of each place, the last one at or below it that has items left, plus one

    def last_left(at: int) -> int:
        """The greatest place up to ``at`` with items left, or -1."""
        path = []
        while at >= 0 and not left[large[at]]:
            path.append(at)
            at = under[at] - 1
        for k in path:
            under[k] = at + 1
        return at

    fits = 0  # large sizes that fit beside the one at hand; grows as it shrinks
    for top in range(len(large) - 1, -1, -1):
        s = large[top]
        while fits < len(large) and large[fits] + s <= capacity:
            fits += 1
        while left[s]:
            at = last_left(min(fits - 1, top))
            if at < 0:  # no partner
                add(left[s], capacity - s, (s, 1))
                left[s] = 0
            elif at == top:
                if left[s] > 1:
                    add(left[s] // 2, capacity - 2 * s, (s, 2))
                    left[s] %= 2
                else:  # a single one takes the next smaller
                    left[s] = 0
                    at = last_left(top - 1)
                    if at < 0:
                        add(1, capacity - s, (s, 1))
                    else:
                        put(Pattern(1, capacity - s - large[at], (large[at], 1), Pattern(1, capacity - s, (s, 1))))
                        left[large[at]] -= 1
            else:
                p = large[at]
                m = min(left[s], left[p])
                put(Pattern(m, capacity - s - p, (p, 1), Pattern(m, capacity - s, (s, 1))))
                left[s] -= m
                left[p] -= m

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            gap = gaps.least_from(s)
            if gap is None:
                k = capacity // s
                add(n // k, capacity - k * s, (s, k))
                if n % k:
                    add(1, capacity - (n % k) * s, (s, n % k))
                break
            p = open_[gap].pop()
            if not open_[gap]:
                gaps.remove(gap)
            k = gap // s
            m = min(p.count, n // k)
            if m:
                add(m, gap - k * s, (s, k), p)
                n -= m * k
                put(Pattern(p.count - m, gap, p.last, p.before))
            else:  # fewer than one container's worth
                add(1, gap - n * s, (s, n), p)
                put(Pattern(p.count - 1, gap, p.last, p.before))
                n = 0
    return done + [p for ps in open_.values() for p in ps]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, first container, slots in each container) of all patterns."""
    used: dict[int, int] = {}
    out, container = [], 0
    for p in patterns:
        for s, k in p.sizes:
            at = used.get(s, 0)
            out.append((s, at, at + p.count * k, container, k))
            used[s] = at + p.count * k
        container += p.count
    return out


_SLOTS = "pack_id int, size bigint, first bigint, end bigint, container bigint, each bigint, stretch bigint"


def _matched(histogram: pd.DataFrame) -> pd.DataFrame:
    """The slots of one container size, from (pack_id, capacity, size, n), with the length of a size's stretches."""
    pack, capacity = histogram["pack_id"].iloc[0], int(histogram["capacity"].iloc[0])
    found = slots(pack_histogram(dict(zip(histogram["size"].tolist(), histogram["n"].tolist())), capacity))
    out = pd.DataFrame(found, columns=["size", "first", "end", "container", "each"])
    lengths = (out["end"] - out["first"]).groupby(out["size"])
    out["stretch"] = np.minimum(_STRETCH, np.ceil(lengths.transform("mean"))).astype("int64")
    out.insert(0, "pack_id", pack)
    return out


_RANKED = "pack_id int, id bigint, piece int, size bigint, part int, place bigint"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each (pack, size) within the task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    met: dict[tuple[int, int], int] = {}
    for batch in batches:
        place = []
        for key in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            k = met.get(key, 0)
            place.append(k)
            met[key] = k + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(place), pa.int32()), pa.array(place, pa.int64())],
            ["pack_id", "id", "piece", "size", "part", "place"],
        )


def packed(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_id, id, piece, tokens, container) for every container size in ``limits(pack_id, capacity_tokens)``.

    ``sizes`` is (id, tokens). An item within the capacity is its one piece 0.
    """
    spark = sizes.sparkSession
    packs = [(r.pack_id, r.capacity_tokens) for r in collect_small(limits.select("pack_id", "capacity_tokens").distinct(), 1000)]
    if any(not c or c < 1 for _, c in packs):
        raise ValueError("a capacity must be 1 at least")
    once = sizes.where("tokens > 0 and id is not null").groupBy("id").agg(F.max("tokens").alias("tokens"))
    caps = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in packs])
    pieces = (
        once.select("id", "tokens", F.explode(caps).alias("c")).select("id", "tokens", "c.pack_id", "c.capacity")
        .select("pack_id", "id", "tokens", "capacity", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)).alias("piece"))
        .select("pack_id", "id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("size"))
    )
    ranked = checkpoint(
        pieces.repartitionByRange(shuffle_partitions(spark), "pack_id", "size", "id", "piece")
        .sortWithinPartitions("pack_id", "size", "id", "piece")
        .mapInArrow(_place, _RANKED)
    )
    counts = checkpoint(ranked.groupBy("pack_id", "size", "part").agg(F.count("*").alias("n")))
    over = W.partitionBy("pack_id", "size").orderBy("part")
    offsets = counts.select("pack_id", "size", "part", (F.sum("n").over(over) - F.col("n")).alias("offset"))
    capacity = F.element_at(F.create_map(*[F.lit(x) for p, c in packs for x in (p, c)]), F.col("pack_id")).alias("capacity")
    histogram = counts.groupBy("pack_id", "size").agg(F.sum("n").alias("n")).select("pack_id", capacity, "size", "n")
    matched = checkpoint(histogram.groupBy("pack_id").applyInPandas(_matched, _SLOTS))  # at most capacity rows a group
    stretches = matched.select("pack_id", "size", "stretch").distinct()
    numbered = (
        ranked.join(broadcast_if_small(offsets.join(stretches, ["pack_id", "size"])), ["pack_id", "size", "part"])
        .withColumn("rank", F.col("offset") + F.col("place"))
        .withColumn("at", F.floor(F.col("rank") / F.col("stretch")))
    )
    touched = F.explode(F.sequence(F.floor(F.col("first") / F.col("stretch")), F.floor((F.col("end") - 1) / F.col("stretch")))).alias("at")
    return (
        numbered.join(broadcast_if_small(matched.select("pack_id", "size", "first", "end", "container", "each", touched)), ["pack_id", "size", "at"])
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .select(
            "pack_id", "id", "piece", F.col("size").alias("tokens"),
            (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("container"),
        )
    )


def fill_report(assignment: DataFrame, limits: DataFrame) -> DataFrame:
    """Per container size: items, containers, share of the space used, and the least containers any packing needs."""
    caps = limits.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    per = assignment.groupBy("pack_id", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return (
        per.join(broadcast_if_small(caps), "pack_id")
        .groupBy("pack_id", "capacity")
        .agg(
            F.sum("pieces").alias("pieces"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"),
            F.max("tokens").alias("fullest"),
        )
        .select("*", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"),
                F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))
    )
