"""Work that runs beside the program that asked for it: submitted, waited for, polled and cancelled."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, ThreadPoolExecutor, wait
from typing import Generic, TypeVar

from pyspark.sql import SparkSession

R = TypeVar("R")


class Event(Generic[R]):
    """A handle on submitted work, whose Spark jobs all bear its tag."""

    def __init__(self, spark: SparkSession, pool: ThreadPoolExecutor, work: Callable[[], R]):
        self.spark, self.tag, self._cancelled = spark, f"lattica-{uuid.uuid4().hex}", False
        self._future = pool.submit(self._run, work)

    def _run(self, work: Callable[[], R]) -> R:
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            if self._cancelled:
                raise CancelledError(self.tag)
            return work()
        finally:
            sc.removeJobTag(self.tag)

    def done(self) -> bool:
        return self._future.done()

    def wait(self, seconds: float | None = None) -> R:
        """The work's result, or what it raised; TimeoutError if it takes longer than so many seconds."""
        return self._future.result(seconds)

    def cancel(self) -> bool:
        """End the work's jobs, running and to come; False if it had ended before."""
        self._cancelled = True
        if self._future.cancel():
            return True
        if self._future.done():
            return False
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return True


class Queue:
    """Runs up to ``width`` submitted works at once, each from a thread of its own; ``with`` waits for all at its end."""

    def __init__(self, spark: SparkSession, width: int = 4):
        self.spark, self._pool = spark, ThreadPoolExecutor(width, thread_name_prefix="lattica-queue")

    def submit(self, work: Callable[[], R]) -> Event[R]:
        return Event(self.spark, self._pool, work)

    def __enter__(self) -> Queue:
        return self

    def __exit__(self, *_) -> None:
        self._pool.shutdown()


def wait_all(*events: Event) -> list:
    """The results of all events, once the last has ended."""
    wait([e._future for e in events])
    return [e.wait() for e in events]
