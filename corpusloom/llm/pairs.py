"""Pairs within groups. A hot group is cut into blocks that meet two by two, each two in a task of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small

#: Members of a block.
BLOCK = 2_000


def hot_groups(sizes: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, blocks) of the groups that are too large for one task, from (key, n)."""
    return sizes.where(F.col("n") > block).select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def in_cells(items: DataFrame, key: str, item: str, hot: DataFrame) -> DataFrame:
    """``items`` with the ``cell`` they meet in and their ``side`` there.

    A group that isn't hot has one cell. A member of a hot one, in block b, stands in a cell for each block: with
    its own block, where all meet all (side 0), or with another, where the two sides meet. Each pair so has one cell.
    """
    own = F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = items.join(broadcast_if_small(hot), key, "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cell = low.cast("long") * F.lit(1 << 31) + high
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte")
    return placed.select(*items.columns, cell.alias("cell"), side.alias("side"))


def cell_pairs(celled: DataFrame, key: str, item: str) -> DataFrame:
    """Two rows of each cell whose items are in order, as (key, cell, <column>_a..., <column>_b...)."""
    rest = [c for c in celled.columns if c not in (key, "cell")]
    a = celled.select(key, "cell", *[F.col(c).alias(f"{c}_a") for c in rest])
    b = celled.select(key, "cell", *[F.col(c).alias(f"{c}_b") for c in rest])
    meet = (F.col("side_a") != F.col("side_b")) | (F.col("side_a") == 0)
    return a.join(b.hint("merge"), [key, "cell"]).where((F.col(f"{item}_a") < F.col(f"{item}_b")) & meet)
