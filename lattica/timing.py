"""Timing of repeated runs on the driver's clock, and what the executors have spent on a run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass
class Timer:
    """Seconds of the runs of one thing."""

    seconds: list[float] = field(default_factory=list)

    def run(self, thing: Callable[[], object], times: int = 1) -> Timer:
        for _ in range(times):
            began = time.perf_counter()
            thing()
            self.seconds.append(time.perf_counter() - began)
        return self

    @property
    def mean(self) -> float:
        return fmean(self.seconds) if self.seconds else 0.0

    @property
    def deviation(self) -> float:
        return pstdev(self.seconds) if self.seconds else 0.0

    def prune(self, multiple: float = 1.0) -> int:
        """Leave out runs further than so many deviations from the mean; returns how many went."""
        mean, most = self.mean, multiple * self.deviation
        kept = [s for s in self.seconds if abs(s - mean) <= most]
        gone = len(self.seconds) - len(kept)
        self.seconds = kept or self.seconds
        return gone if kept else 0


@dataclass(frozen=True)
class Spent:
    """What all tasks of a run took together, as the session's own metrics of its stages have it."""

    stages: int = 0
    tasks: int = 0
    task_seconds: float = 0.0
    cpu_seconds: float = 0.0
    input_bytes: int = 0
    shuffle_read: int = 0
    shuffle_written: int = 0
    spilled: int = 0


def spent(spark: SparkSession, thing: Callable[[], object]) -> Spent:
    """Run something and add up the metrics of the stages of all jobs that it started from this thread.

    Stages that the session has forgotten by then (``spark.ui.retainedStages``) are not in the sums.
    """
    sc, tag = spark.sparkContext, f"lattica-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    try:
        thing()
    finally:
        sc.removeJobTag(tag)
    context = sc._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    store = context.statusStore()
    jobs = [j for j in (_known(store.job, k) for k in context.statusTracker().getJobIdsForTag(tag)) if j is not None]
    stages = {j.stageIds().apply(k) for j in jobs for k in range(j.stageIds().size())}
    ran = [s for s in (_known(store.lastStageAttempt, k) for k in stages) if s is not None and s.numCompleteTasks()]  # stages whose output was there already ran none
    total = lambda of: sum(of(s) for s in ran)
    return Spent(
        len(ran),
        total(lambda s: s.numCompleteTasks()),
        total(lambda s: s.executorRunTime()) / 1e3,
        total(lambda s: s.executorCpuTime()) / 1e9,
        total(lambda s: s.inputBytes()),
        total(lambda s: s.shuffleReadBytes()),
        total(lambda s: s.shuffleWriteBytes()),
        total(lambda s: s.diskBytesSpilled()),
    )


def _known(of: Callable[[int], object], number: int) -> object | None:
    """What the status store holds under a number, or None."""
    try:
        return of(number)
    except Py4JJavaError as e:
        if "NoSuchElement" not in str(e.java_exception):
            raise
        return None
