"""Cut of a lineage in the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir. Where the session names none, one of our own in local mode only, as in tests: on a cluster a folder of one machine
    would be lost with it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "spanloom-checkpoints")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot with more than this part of all rows, so at most this many are; below LEAST_HOT rows none is.
HOT_PART, LEAST_HOT = 1000, 1000


def join_hot(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with per_key(*keys, n, ...), which has one row a key and tells in n how many rows have it. The at most HOT_PART hot keys meet their rows where these lie; the others are shuffled,
    and none of them makes a large part. Both are read twice: cut them before."""
    total = per_key.agg(F.sum("n").alias("n")).first().n or 0
    least = max(LEAST_HOT, total // HOT_PART)
    hot, rest = per_key.where(F.col("n") > least).drop("n"), per_key.where(F.col("n") <= least).drop("n")
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys, how).unionByName(others.join(rest, keys, how))


#: Inputs of at most this size are spread over all cores before work in Python; larger ones come in enough parts.
SMALL_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many parts as there are cores, where it is small: a file of one row group is one task else. The rows are the same, and so is what operators make
    of them, which depends on no partitioning. A session that tells no size (a remote one) leaves df as it is."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return df
    leaves = plan.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df
