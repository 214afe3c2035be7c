"""Session helpers shared by all operators: tables, checkpoints, sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under the folder ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a private one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of short keys that may be sent to every executor: about 20 MB.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of ``df`` when it has at most ``rows`` rows; beyond that Spark shuffles.

    ``df`` should be checkpointed or a small table, as its rows are counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def collect_small(df: DataFrame, rows: int) -> list[Row]:
    """All rows of a small table; more than ``rows`` are an error, as none may be dropped."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a table of ({', '.join(df.columns)}) has more than {rows} rows")
    return found


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when it comes from very few files; a larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
