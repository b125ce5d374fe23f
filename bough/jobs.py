"""Queries in the background: bounded in number, awaited, cancelled.

A timeout or a cancellation settles a job at once for whoever awaits it, and asks
Spark to cancel the job group its thread runs under. That request is best effort: a
query whose jobs Spark doesn't count to the group goes on until it is done, and its
result is dropped; until then it holds its worker.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any

from pyspark.sql import SparkSession

from bough.model import EngineError


class Job:
    """A submitted query."""

    def __init__(self, spark: SparkSession, tag: str):
        self._spark, self.tag = spark, tag
        self._future: Future = Future()
        self._cancelled = False
        self._lock = threading.Lock()

    def await_(self, timeout: float | None = None) -> Any:
        """Its result. A job that isn't done in time goes on; ``cancel`` ends it."""
        try:
            return self._future.result(timeout)
        except (Late, TimeoutError) as e:
            raise EngineError("await_timeout", "the job goes on") from e
        except CancelledError as e:
            raise EngineError("cancelled") from e
        except EngineError:
            raise
        except Exception as e:
            if self._cancelled:
                raise EngineError("cancelled") from e
            raise

    def cancel(self) -> None:
        self._cancelled = True
        if not self._future.cancel():
            self._settle(EngineError("cancelled"))
            self._spark.sparkContext.cancelJobGroup(self.tag)

    def _settle(self, outcome: Any) -> bool:
        """Set the result or the error, if there is none yet."""
        with self._lock:
            if self._future.done():
                return False
            if isinstance(outcome, BaseException):
                self._future.set_exception(outcome)
            else:
                self._future.set_result(outcome)
            return True

    def status(self) -> str:
        if not self._future.done():
            return "running" if self._future.running() else "queued"
        return "cancelled" if self._cancelled else "failed" if self._future.exception() else "done"


class Runtime:
    """A pool of workers with a bounded queue, and a bound on the jobs of one owner."""

    def __init__(self, spark: SparkSession, workers: int = 4, max_queue: int = 1000, max_per_owner: int = 16):
        if min(workers, max_queue, max_per_owner) < 1:
            raise EngineError("invalid_argument", "the bounds must be positive")
        self._spark, self._pool = spark, ThreadPoolExecutor(workers)
        self._most, self._per_owner = workers + max_queue, max_per_owner
        self._owners: dict[object, int] = {}
        self._lock = threading.Lock()
        self._counts = dict.fromkeys(("submitted", "completed", "failed", "cancelled", "rejected"), 0)

    def submit(self, query: Callable[[], Any], owner: object = None, timeout_ms: int | None = None) -> Job:
        """Start a query; busy if the queue or the owner's share is full. After timeout_ms it is cancelled and its result is a timeout."""
        with self._lock:
            if sum(self._owners.values()) >= self._most or self._owners.get(owner, 0) >= self._per_owner:
                self._counts["rejected"] += 1
                raise EngineError("busy", "too many jobs", retry_after_ms=100)
            self._owners[owner] = self._owners.get(owner, 0) + 1
            self._counts["submitted"] += 1
        job = Job(self._spark, f"bough-{uuid.uuid4().hex}")

        def expire() -> None:
            if job._settle(EngineError("timeout", f"over {timeout_ms} ms")):
                self._spark.sparkContext.cancelJobGroup(job.tag)

        def run() -> None:
            timer = None
            outcome = "cancelled"
            try:
                if not job._future.set_running_or_notify_cancel():
                    return
                sc = self._spark.sparkContext
                sc.setJobGroup(job.tag, "bough", True)
                if timeout_ms is not None:
                    timer = threading.Timer(timeout_ms / 1000, expire)
                    timer.daemon = True
                    timer.start()
                try:
                    outcome = "completed" if job._settle(query()) else "failed"
                except BaseException as e:
                    job._settle(e)
                    outcome = "failed"
                finally:
                    sc.setLocalProperty("spark.jobGroup.id", None)
                if job._cancelled:
                    outcome = "cancelled"
            finally:
                if timer:
                    timer.cancel()
                with self._lock:
                    self._owners[owner] -= 1
                    self._counts[outcome] += 1

        self._pool.submit(run)
        return job

    def stats(self) -> dict[str, int]:
        with self._lock:
            return {**self._counts, "in_flight": sum(self._owners.values())}

    def close(self, grace: float = 0.0) -> None:
        time.sleep(grace)
        self._pool.shutdown(wait=False, cancel_futures=True)
