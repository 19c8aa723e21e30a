"""What a long job leaves on the disks."""

import time

import pytest
from pyspark.sql import functions as F

from playtrail import scratch
from playtrail.operators import factors, nonnegative


def shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) for name in [files.apply(i).getName()] if name.startswith("shuffle_")}


def settles(spark, most: int) -> bool:
    until = time.monotonic() + 20
    while len(shuffles(spark)) > most and time.monotonic() < until:
        time.sleep(0.2)
    return len(shuffles(spark)) <= most


@pytest.mark.parametrize("write", [scratch.pin, lambda df: scratch.through_table(df, "steps")])
def test_written_steps_leave_no_shuffle_files(spark, monkeypatch, write):
    """Each step's shuffle files lay there until the driver collected its garbage of its own accord."""
    monkeypatch.setattr(scratch, "SWEEP_S", 0)
    scratch.sweep(spark)
    time.sleep(1)
    before, df = len(shuffles(spark)), spark.range(400).withColumn("k", F.col("id") % 50)
    made = []
    for i in range(16):
        df = write(df.groupBy("k").agg(F.sum("id").alias("id")).withColumn("k", F.col("k") + i))
        made.append(len(shuffles(spark)))
    assert settles(spark, before + 20), (before, made)  # the last steps' files; sixteen steps leave some sixty
    assert df.count() == 50


def test_epochs_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(scratch, "SWEEP_S", 0)
    scratch.sweep(spark)
    time.sleep(1)
    before = len(shuffles(spark))
    ratings = spark.createDataFrame([(u, t, 1.0) for u in range(20) for t in range(9)], "account_id bigint, content_id bigint, rating double")
    nonnegative.fit_nonnegative(ratings, 2, 6)
    assert settles(spark, before + 40)  # one epoch's and the last sums; six epochs leave some hundred


def test_the_solver_leaves_no_steps_behind(spark, monkeypatch):
    """Factors were sent to the other side in every step, and the files of five steps lay there till the fit was over."""
    asked, als = [], factors.ALS
    monkeypatch.setattr(factors, "ALS", lambda **params: asked.append(params["checkpointInterval"]) or als(**params))
    rows = spark.createDataFrame([(u, t, 1) for u in range(20) for t in range(u % 4, 12, 2)], "account_id bigint, content_id bigint, n bigint")
    assert factors.fit_implicit(rows, 3).item_factors().count() == 12
    assert factors.fit_nmf(rows.withColumn("rating", F.lit(1.0)), 3).item_factors().count() == 12
    assert asked == [1, 1]
