"""Sessions and their counters: a table of batches that is merged by key when it is read.

What a batch of ledger events says of a session (first and last time, stages, applies, the latest value of each attribute)
can be put together in any order. So a batch is a folder of its own, named by its id, that holds one row for each session;
a batch that comes again replaces its folder, and a reader merges what there is. Compaction puts old batches into one
folder that lists their ids, so that those that come again later are known. Nothing is updated in place and no row is
locked; readers see whole batches only, as a folder is moved into place when it is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIAL = "session_id string, started_at timestamp, last_at timestamp, ended_at timestamp, stages_count long, applies_count long, client string, client_at timestamp"


def counted(events: DataFrame) -> DataFrame:
    """One row for each session of ``events`` (session_id, kind, at, client): started_at, last_at, ended_at, stages_count,
    applies_count, and the last ``client`` that is not null, with its time. kind is stage, apply, end or any other, which only
    counts for times; of clients at the same time the greatest stays. Sums and maxima are combined before the shuffle."""
    at, has = F.col("at").cast("timestamp"), F.col("client").isNotNull()
    newest = F.max(F.when(has, F.struct(at.alias("client_at"), "client"))).alias("newest")
    when = lambda kind: F.col("kind") == kind
    out = events.groupBy("session_id").agg(F.min(at).alias("started_at"), F.max(at).alias("last_at"), F.max(F.when(when("end"), at)).alias("ended_at"), F.count_if(when("stage")).alias("stages_count"), F.count_if(when("apply")).alias("applies_count"), newest)
    return out.select("session_id", "started_at", "last_at", "ended_at", "stages_count", "applies_count", "newest.client", "newest.client_at")


def merged(partials: DataFrame) -> DataFrame:
    """Rows of ``counted`` put together by session: sums, first and last times, the last writer's client."""
    newest = F.max(F.when(F.col("client").isNotNull(), F.struct("client_at", "client"))).alias("newest")
    out = partials.groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"), F.max("ended_at").alias("ended_at"), F.sum("stages_count").alias("stages_count"), F.sum("applies_count").alias("applies_count"), newest)
    return out.select("session_id", "started_at", "last_at", "ended_at", "stages_count", "applies_count", "newest.client", "newest.client_at")


class Sessions:
    """The table in ``folder``, on a file system that executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self) -> list[str]:
        """Folders of batches and of compactions."""
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def _known(self, names: list[str]) -> tuple[list[str], set[str]]:
        """Folders to read, and the ids of all batches in them. Of compactions the one with the most batches counts."""
        bases = {x: set(self._ids(x)) for x in names if x.startswith("base-")}
        base = max(bases, key=lambda x: (len(bases[x]), x), default=None)
        inside = bases.get(base, set())
        batches = [x for x in names if x.startswith("batch-") and x.removeprefix("batch-") not in inside]
        return batches + ([base] if base else []), inside | {x.removeprefix("batch-") for x in batches}

    def _ids(self, base: str) -> list[str]:
        return [r.id for r in self.spark.read.schema("id string").parquet(f"{self.folder}/{base}/ids").collect()]  # a short name for each batch

    def _place(self, rows: DataFrame, name: str, ids: list[str] | None = None) -> None:
        """Write aside and move into place: a folder is there with all its rows or not at all."""
        aside = f".{name}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.folder}/{aside}/rows")
        if ids is not None:
            self.spark.createDataFrame([(x,) for x in ids], "id string").coalesce(1).write.parquet(f"{self.folder}/{aside}/ids")
        self._fs.delete(self._path(name), True)
        if not self._fs.rename(self._path(aside), self._path(name)):
            raise OSError(f"{self.folder}/{name} cannot be written")

    def merge(self, batch: str | int, events: DataFrame) -> bool:
        """Add a batch of events, whose id is a name of letters, digits and dashes. One that comes again takes the place of
        what it said before, or is left out (false) once it is part of a compaction."""
        batch = str(batch)
        if not batch.replace("-", "").isalnum():
            raise ValueError(f"no name of a batch: {batch!r}")
        names = self._names()
        if any(batch in self._ids(x) for x in names if x.startswith("base-")):
            return False
        self._place(counted(events), f"batch-{batch}")
        return True

    def table(self) -> DataFrame:
        """One row for each session."""
        names, _ = self._known(self._names())
        if not names:
            return self.spark.createDataFrame([], PARTIAL).drop("client_at")
        return merged(self.spark.read.schema(PARTIAL).parquet(*[f"{self.folder}/{x}/rows" for x in names])).drop("client_at")

    def compact(self) -> int:
        """Put all batches into one folder; returns how many it holds."""
        names, ids = self._known(self._names())
        if names:
            rows = self.spark.read.schema(PARTIAL).parquet(*[f"{self.folder}/{x}/rows" for x in names])
            self._place(merged(rows), f"base-{len(ids)}-{uuid.uuid4().hex[:8]}", sorted(ids))
            for x in names:
                self._fs.delete(self._path(x), True)
        return len(ids)

    def sink(self):
        """For ``foreachBatch``: batches of a stream are merged by their number, so that those that come again count once."""
        return lambda events, number: self.merge(f"stream-{number}", events)
