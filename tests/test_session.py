"""Written stages."""

import time

from eventide.driver import feature_queries, views
from eventide.session import SHUFFLE_CLEANUP, materialize


def shuffle_files(spark) -> int:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.length()))


def test_shuffles_of_a_written_stage_are_removed(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    plan = spark.range(1000).repartition(5, "id")
    out = materialize(plan.sortWithinPartitions("id"), "cleanup")
    end = time.time() + 20
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert out.count() == 1000 and plan.count() == 1000


def test_stages_are_written_compressed(spark, monkeypatch):
    monkeypatch.setattr(views, "_STAGED", {})
    out = views.staged(spark, "nowhere", "small", lambda: spark.range(10))
    assert out.count() == 10 and all(".zstd." in f for f in out.inputFiles())


def test_matrix_positions_reads_only_its_cells(spark, monkeypatch):
    """The split that cells carry tells training rows; the samples are not joined again."""
    cells = spark.createDataFrame(
        [("s", 0, "f0", 1.0, "train"), ("s", 1, "f0", 2.0, "train"), ("t", 0, "f0", 3.0, "train"), ("u", 2, "f0", 4.0, "test")],
        "sample_id string, period_offset int, anonymous_feature_id string, value double, split string")
    monkeypatch.setattr(views, "cells", lambda spark, d: cells)
    assert feature_queries.matrix_positions(spark, "nowhere").first().fact_positions == 2
