"""Seconds, task seconds and memory of parts of a run, as Spark itself has measured them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Measured:
    """Filled when the part ends: wall ``seconds``, ``task_seconds`` of all its jobs, and the greatest ``peak_mb`` of execution memory that the tasks of one stage report."""

    seconds = task_seconds = peak_mb = 0.0
    jobs = 0


@contextmanager
def measured(spark: SparkSession, name: str) -> Iterator[Measured]:
    """Runs the jobs of a part under a job group of its own and reads their stages from the status store."""
    context, out = spark.sparkContext, Measured()
    group, before = f"{name}-{uuid.uuid4().hex}", {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")}
    context.setJobGroup(group, name)
    began = time.time()
    try:
        yield out
    finally:
        out.seconds = time.time() - began
        for k, value in before.items():
            context.setLocalProperty(k, value)
        context._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
        stages = set()
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            out.jobs += 1
            stages.update(info.stageIds if info is not None else ())
        for stage in stages:
            if tracker.getStageInfo(stage) is not None:  # None: skipped, or no longer kept
                data = store.lastStageAttempt(stage)
                out.task_seconds += data.executorRunTime() / 1000
                out.peak_mb = max(out.peak_mb, data.peakExecutionMemory() / 1e6)
