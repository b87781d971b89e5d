"""The folder that all executors and the driver share, and checkpoints in it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, else the context's folder.

    A folder of this machine serves only where the master is local; elsewhere the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def checkpoint_counted(df: DataFrame, count: Column | None = None) -> tuple[DataFrame, int]:
    """The checkpoint and its number of rows (or another count), taken by the same job."""
    seen = Observation()
    df = checkpoint(df.observe(seen, (F.count(F.lit(1)) if count is None else count).alias("n")))
    return df, seen.get["n"]


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet files in a folder of the shared one, for state that goes from round to round.

    A checkpoint keeps the size that Spark estimated for its plan, and a join's estimate is the product of its sides'. Where rounds join
    the state of the round before, the digits of that number multiply with each round, until the driver is full of it. A table of
    files is as large as its files.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, path: str, count: Column) -> tuple[DataFrame, int]:
    """As stored(), with a count that is taken by the same job."""
    seen = Observation()
    df = stored(df.observe(seen, count.alias("n")), path)
    return df, seen.get["n"]


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, checkpointed and counted, marked for a broadcast if it has no more rows than this (of a few numbers each)."""
    df = checkpoint(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
