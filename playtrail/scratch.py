"""Reliable scratch space: checkpoints and intermediate tables in the shared folder."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []
#: Seconds between two sweeps at least, and when the last one was.
SWEEP_S = 5.0
_SWEPT = [0.0]


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files (and checkpoints, where it is set to) of tables that nothing refers to any more.

    It deletes them when the driver collects its garbage, which a driver that holds little hardly ever does: the files of all steps
    of a long job lay on the executors' disks to its end.
    """
    if time.monotonic() - _SWEPT[0] >= SWEEP_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _SWEPT[0] = time.monotonic()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; below the warehouse where none is configured.

    A folder of one machine's disk is refused when executors run on other machines.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        folder = configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        local = folder.startswith("file:") or "://" not in folder
        if local and not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def pin(df: DataFrame) -> DataFrame:
    """Fix ``df`` in reliable storage, so that recomputing a lost task cannot change it."""
    scratch_dir(df.sparkSession)
    sweep(df.sparkSession)
    return df.checkpoint(eager=True)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and read it back.

    Unlike a checkpoint the result keeps column pruning, pushed filters and size
    statistics for its readers.
    """
    path = scratch_path(df.sparkSession, name)
    sweep(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the input: the join is sorted and merged, never sent whole to all tasks.

    Spark guesses pinned and compressed tables far below what their rows take in memory; item vectors that it took
    for a few megabytes were collected on the driver.
    """
    return df.hint("merge")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of our own in the scratch space."""
    if not path.startswith(scratch_dir(spark)):
        raise ValueError(f"{path} is not in the scratch folder")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving every scratch table made inside; results must be written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_path(spark, path)
