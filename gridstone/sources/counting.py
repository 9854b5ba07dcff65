"""What a query has read, by Spark's own input metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple, TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Measured(NamedTuple):
    """The jobs that a call ran, and the bytes and rows that their tasks read from files."""

    jobs: int
    bytes_read: int
    rows_read: int


def measured(spark: SparkSession, run: Callable[[], T]) -> tuple[T, Measured]:
    """The result of run(), and what its jobs read. Parquet reads one range after another meanwhile: bytes of reads that run beside each other aren't counted."""
    sc, group = spark.sparkContext, f"measured-{uuid.uuid4().hex}"
    conf, name = sc._jsc.hadoopConfiguration(), "parquet.hadoop.vectored.io.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    sc.setJobGroup(group, "measured")
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        conf.unset(name) if before is None else conf.set(name, before)
    tracker, kept = sc.statusTracker(), sc._jsc.sc().statusStore()
    jobs = list(tracker.getJobIdsForGroup(group))
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    size = rows = 0
    for s in stages:
        if tracker.getStageInfo(s) is None:  # skipped: an earlier job had its result
            continue
        stage = kept.lastStageAttempt(s)
        size, rows = size + stage.inputBytes(), rows + stage.inputRecords()
    return out, Measured(len(jobs), int(size), int(rows))
