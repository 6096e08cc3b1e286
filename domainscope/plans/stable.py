"""Rows that must hold from one evaluation to the next, and rows that are kept for a while."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local session without one gets a folder of its own; on a cluster that is an
    error, as executors would write where others can't read."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir"):
        return named
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def stable(df: DataFrame) -> DataFrame:
    """df, written once: whatever numbers its rows got, or wherever they were dealt, stays so when a task runs again."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row that holds."""
    return stable(df.withColumn(name, F.monotonically_increasing_id()))


@contextmanager
def kept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that persists frames until the block ends: for frames that are read several times by jobs within it."""
    frames: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        frames.append(df.persist())
        return frames[-1]

    try:
        yield keep
    finally:
        for f in frames:
            f.unpersist()
