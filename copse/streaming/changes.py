"""What changed in a folder: the difference of successive listings, as events that are kept.

A poll lists the scope, meets the listing before it by path (a full outer join of two narrow tables) and keeps the events
and the new listing under the next number. Both are written aside and moved into place at once, so that a poll is there
or it is not: after a restart the next one goes on from the last that is there, and no event is lost or told twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from copse.sources import files

SNAPSHOT = "uri string, mark string"
EVENTS = "uri string, type string"


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events (uri, type) between two snapshots (uri, mark), where mark tells contents apart.

    updated for what is new or has another mark, removed for what is gone, and one list_changed (uri null) if anything came
    or went. A null mark is one like any other; a uri that a snapshot holds more than once counts with its greatest mark.
    """
    one = lambda df, name: df.filter("uri is not null").groupBy("uri").agg(F.max("mark").alias(name), F.lit(True).alias(f"has_{name}"))
    met = one(before, "old").join(one(after, "new"), "uri", "full_outer")
    kind = F.when(F.col("has_new").isNull(), "removed").when(F.col("has_old").isNull(), "created").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    met = met.select("uri", kind.alias("kind")).filter("kind is not null")
    own = met.select("uri", F.when(F.col("kind") == "removed", "removed").otherwise("updated").alias("type"))
    listed = met.filter("kind <> 'updated'").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(None).cast("string").alias("uri"), F.lit("list_changed").alias("type"))
    return own.unionByName(listed)


class Feed:
    """The events of a scope, kept in ``state`` (a folder that executors share). by_content: files are told apart by their
    digest, and read at every poll, in place of by size and time."""

    def __init__(self, spark: SparkSession, scope: files.Scope, state: str, by_content: bool = False) -> None:
        self.spark, self.scope, self.state, self.by_content = spark, scope, state.rstrip("/"), by_content
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}" if name else self.state)

    def last(self) -> int:
        """The number of the last poll; 0 if there is none."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        return max((int(x.removeprefix("poll-")) for x in names if x.startswith("poll-")), default=0)

    def snapshot(self) -> DataFrame:
        found = files.walk(self.spark, self.scope).select("doc", F.col("sha256").alias("mark")) if self.by_content else files.listing(self.spark, self.scope).select("doc", F.concat_ws(":", "size", "stamp").alias("mark"))
        return found.withColumnRenamed("doc", "uri")

    def events(self, poll: int) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.state}/poll-{poll}/events")

    def poll(self) -> int:
        """List the scope and keep what changed since the poll before; the first one only lists. Returns its number, or the
        last one's if nothing changed since."""
        last = self.last()
        aside = f".poll-{uuid.uuid4().hex[:12]}"
        self.snapshot().write.parquet(f"{self.state}/{aside}/listing")
        now = self.spark.read.schema(SNAPSHOT).parquet(f"{self.state}/{aside}/listing")
        before = self.spark.read.schema(SNAPSHOT).parquet(f"{self.state}/poll-{last}/listing") if last else now
        compared(before, now).write.parquet(f"{self.state}/{aside}/events")
        if last and self.spark.read.schema(EVENTS).parquet(f"{self.state}/{aside}/events").isEmpty():
            self._fs.delete(self._path(aside), True)
            return last
        if not self._fs.rename(self._path(aside), self._path(f"poll-{last + 1}")):
            raise OSError(f"poll {last + 1} of {self.state} cannot be written")
        return last + 1

    def follow(self, handle, checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
        """Polls at every trigger and calls ``handle(events, number)`` for each poll with events that it has not been called for.
        A call that fails comes again with the same number; stopping the query ends the subscription."""

        def step(_: DataFrame, __: int) -> None:
            done = self._told(checkpoint)
            for number in range(max(done + 1, 2), self.poll() + 1):
                handle(self.events(number), number)
                self._fs.mkdirs(self._told_path(checkpoint, number))

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/ticks").trigger(processingTime=f"{seconds} seconds").start()

    def _told_path(self, checkpoint: str, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/told/{number}")

    def _told(self, checkpoint: str) -> int:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/told")
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(top)), default=0) if self._fs.exists(top) else 0
