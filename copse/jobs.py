"""Work under a token: its progress as a DataFrame, a limit of time, and cancelling it without the session's other queries.

Spark's jobs carry tags; all jobs that a token's work starts have its tag, those of plans that are run within it too. So it
is cancelled by tag, and its progress is what Spark's status tracker says of the stages of its jobs.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PROGRESS = "token string, state string, seconds double, jobs int, stages int, tasks int, completed int, failed int, active int"
#: Seconds that the operations of the engine may take.
LIMITS = {"file_query": 30.0, "file_replace": 60.0, "file_delete": 60.0, "recipe": 120.0}
#: Seconds that work which is ended may take to notice.
GRACE = 30.0


def _local(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    types = to_arrow_schema(T._parse_datatype_string(PROGRESS))
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(types), types)], schema=types))


class Cancelled(RuntimeError):
    """Work that was ended by its token."""


class TimedOut(Cancelled):
    """Work that took longer than it may."""


class Work:
    """An action that runs in a thread of its own. state: running, done, failed, cancelled or timed_out."""

    def __init__(self, spark: SparkSession, action: Callable[[], object], token: str | None = None, timeout: float | None = None) -> None:
        self.spark, self.token, self.timeout = spark, token or uuid.uuid4().hex, timeout
        self.state, self.began, self.ended = "running", time.monotonic(), None
        self._context, self._action, self._value, self._error = spark.sparkContext, action, None, None
        self._lock, self._over = threading.Lock(), threading.Event()
        self._timer = threading.Timer(timeout, self._end, ["timed_out"]) if timeout else None
        self._thread = InheritableThread(target=self._run, daemon=True)

    def start(self) -> Work:
        if self._timer:
            self._timer.daemon = True
            self._timer.start()
        self._thread.start()
        return self

    def _run(self) -> None:
        self._context.addJobTag(self.token)
        try:
            if self.state == "running":
                self._value = self._action()
            state = "done"
        except BaseException as e:  # noqa: BLE001 - told to whom asks for the result
            self._error, state = e, "failed"
        finally:
            self._context.removeJobTag(self.token)
        with self._lock:
            if self.state == "running":
                self.state = state
            self.ended = self.ended or time.monotonic()
        if self._timer:
            self._timer.cancel()
        self._over.set()

    def _end(self, state: str) -> bool:
        with self._lock:
            if self.state != "running":
                return False
            self.state = state
        until = time.monotonic() + GRACE
        while not self._over.wait(0.1):  # jobs that start between two others are cancelled as well
            self._context.cancelJobsWithTag(self.token)
            if time.monotonic() > until:  # what is not Spark's cannot be ended; nobody waits for it
                self.ended = time.monotonic()
                self._over.set()
        return True

    def cancel(self) -> bool:
        """End the work; false if it is over already. Returns when its jobs have ended."""
        return self._end("cancelled")

    def result(self, wait: float | None = None):
        """What the action returned; its error if it failed."""
        if not self._over.wait(wait):
            raise TimeoutError(f"{self.token} is still running")
        if self.state == "timed_out":
            raise TimedOut(f"{self.token} took more than {self.timeout:g} seconds")
        if self.state == "cancelled":
            raise Cancelled(f"{self.token} was cancelled")
        if self._error is not None:
            raise self._error
        return self._value

    def progress(self) -> DataFrame:
        """One row: jobs and stages that the work has started, and tasks of these that are known, completed, failed, active.
        It is local to the driver: reading it starts no job that would have to wait for the work."""
        tracker = self._context._jsc.sc().statusTracker()
        jobs, stages, sums = list(tracker.getJobIdsForTag(self.token)), set(), [0, 0, 0, 0]
        for job in jobs:
            info = tracker.getJobInfo(job)
            stages |= set(info.get().stageIds()) if info.isDefined() else set()
        for stage in stages:
            info = tracker.getStageInfo(stage)
            if info.isDefined():
                x = info.get()
                ran = (x.numCompletedTasks(), x.numFailedTasks(), x.numActiveTasks())
                if any(ran) or self.ended is None:  # stages whose results were there already are skipped
                    sums = [a + b for a, b in zip(sums, (x.numTasks(), *ran))]
        seconds = (self.ended or time.monotonic()) - self.began
        return _local(self.spark, [(self.token, self.state, seconds, len(jobs), len(stages), *sums)])


class Works:
    """The work of a session by token."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.by_token = spark, {}

    def submit(self, action: Callable[[], object], token: str | None = None, timeout: float | None = None) -> Work:
        """Start ``action``. A token is of one work that runs at a time; those of ended work can be used again."""
        if token in self.by_token and self.by_token[token].state == "running":
            raise ValueError(f"{token} is running")
        work = Work(self.spark, action, token, timeout)
        self.by_token[work.token] = work
        return work.start()

    def cancel(self, token: str) -> bool:
        """False where there is no such work, or it is over."""
        return token in self.by_token and self.by_token[token].cancel()

    def progress(self) -> DataFrame:
        """A row for each work that is known."""
        return _local(self.spark, [tuple(x.progress().first()) for x in self.by_token.values()])
