"""Streams: files of a folder as they come, and stages that expire when their time is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from copse.functions import patterns, scalars
from copse.sources import files

BINARY = "path string, modificationTime timestamp, length long, content binary"
UPDATE = "uri string, type string, size long, mod_time long"


def incoming(spark: SparkSession, scope: files.Scope, per_trigger: int = 1000) -> DataFrame:
    """Documents of new files as a stream, at most ``per_trigger`` files a batch. Depths, globs and languages are those of
    the scope; a stream has no first files, so ``max_files`` is not read. Names that begin with a dot or an underscore are
    passed over by the reader of streams, other than by ``files.listing``."""
    scope = scope.checked()
    here = scope.local()
    root = (here if here is not None else scope.path).rstrip("/")
    found = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(f"file://{root}" if here is not None else root)
    bare = F.regexp_replace("path", "^file:(//)?(?=/)", "") if here is not None else F.col("path")
    out = found.select(bare.alias("doc"), scalars.utf8(F.col("content")).alias("source"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mod_time"), F.sha2("content", 256).alias("sha256"))
    out = out.withColumn("path", F.col("doc").substr(F.lit(len(root) + 2), F.length("doc")))
    out = out.filter(patterns.in_scope(F.col("path"), scope.include, scope.exclude))
    if scope.max_depth:
        out = out.filter(scalars.depth(F.col("path")) <= scope.max_depth)
    return out.withColumn("language", scalars.language(F.col("path"), scope.language)).select("doc", "path", "language", "source", "size", "mod_time", "sha256")


def watch(spark: SparkSession, scope: files.Scope, checkpoint: str, handle, **trigger) -> StreamingQuery:
    """Calls ``handle(updates, batch id)`` with the events (uri, type, size, mod_time) of each batch of new files; stopping the
    query ends the subscription. Batches may come again after a failure, with the same number."""
    updates = incoming(spark, scope).select(F.col("doc").alias("uri"), F.lit("updated").alias("type"), "size", "mod_time")
    return updates.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def select_into(spark: SparkSession, scope: files.Scope, query, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Matches of a selector in new files, as Parquet in ``table`` by batch: a batch that is repeated replaces its own files."""

    def write(docs: DataFrame, batch: int) -> None:
        elements = files.parsed(docs).persist()
        try:
            files.select(elements, query).write.mode("overwrite").parquet(f"{table}/batch={batch}")
        finally:
            elements.unpersist()

    return incoming(spark, scope).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


STATE = "created timestamp, expires timestamp"
OUT = "id string, status string, at timestamp"


class Expiry(StatefulProcessor):
    """Per stage id: pending when it comes, applied if an apply comes in time, expired when event time passes its end.

    Events of a stage that is over give its end's row no second time: state is cleared, later applies are refused.
    """

    def __init__(self, ttl_minutes: int) -> None:
        self.ttl = pd.Timedelta(minutes=ttl_minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stage = handle.getValueState("stage", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "kind"], ascending=[True, False], kind="stable")
        out = []
        for kind, ts in zip(events["kind"], events["ts"]):
            have = self.stage.get() if self.stage.exists() else None
            if kind == "stage" and have is None:
                end = ts + self.ttl
                self.stage.update((ts.to_pydatetime(), end.to_pydatetime()))
                self.handle.registerTimer(int(end.tz_localize("UTC").timestamp() * 1000) if end.tzinfo is None else int(end.timestamp() * 1000))
                out.append((key[0], "pending", ts))
            elif kind == "apply":
                if have is None:
                    out.append((key[0], "refused", ts))
                    continue
                end = pd.Timestamp(have[1])
                late = ts > end
                out.append((key[0], "expired" if late else "applied", end if late else ts))
                self._over()
        yield pd.DataFrame(out, columns=["id", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.stage.exists():
            out.append((key[0], "expired", pd.Timestamp(self.stage.get()[1])))
            self.stage.clear()
        yield pd.DataFrame(out, columns=["id", "status", "at"])

    def _over(self) -> None:
        self.stage.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    def close(self) -> None:
        pass


def expiring(events: DataFrame, ttl_minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """Changes of status (id, status, at) from a stream of events (id, kind stage or apply, ts timestamp)."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy("id").transformWithStateInPandas(Expiry(ttl_minutes), OUT, "Append", "EventTime")
