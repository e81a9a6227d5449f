"""Writing changed documents back: transactions of staged files with a log, backups, rollback; nothing is half-written.

A change is a row (path, original, modified). Writing takes three steps. ``stage`` writes the new texts and a log of
operations to a transaction's folder, one task for each part of the files, so that a lost executor repeats its own part only.
``commit`` checks each target's digest and moves files into place. ``rollback`` restores what was moved. The log is a table
(tx, op, path, kind, before, after, backup, status), which ``pending`` and ``summary`` read.

Paths are on a file system that all executors share. ``kind`` is modify, create or delete; a null original creates, a null
modified deletes.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.operators import ledger, safety

LOG = "tx string, op string, path string, kind string, before string, after string, backup string, status string, error string"
STATUSES = ("pending", "committed", "rolled_back", "failed")


class TransactionError(RuntimeError):
    """A commit that cannot be made; files are as they were."""


@dataclass(frozen=True)
class Transaction:
    """A folder with ``ops`` (the log as staged), ``done`` (what commit did) and ``status``."""

    spark: SparkSession
    folder: str
    id: str

    @property
    def place(self) -> str:
        return os.path.join(self.folder, self.id)

    def status(self) -> str:
        with open(os.path.join(self.place, "status"), encoding="utf-8") as f:
            return f.read().split()[0]

    def mark(self, status: str) -> None:
        _put(os.path.join(self.place, "status"), f"{status} {int(time.time())}".encode())

    def log(self, name: str = "ops") -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"file://{self.place}/{name}")


def digest(path: str) -> str:
    """SHA-256 of a file, '' if there is none."""
    if not os.path.exists(path):
        return ""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _put(path: str, data: bytes, mode: int | None = None) -> None:
    """All of ``data`` or nothing: a file beside it takes its name."""
    beside = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    if mode is not None:
        os.chmod(beside, mode)
    os.replace(beside, path)


def begin(spark: SparkSession, folder: str) -> Transaction:
    tx = Transaction(spark, os.path.abspath(folder), f"tx_{time.time_ns()}_{uuid.uuid4().hex[:8]}")
    os.makedirs(os.path.join(tx.place, "new"))
    os.makedirs(os.path.join(tx.place, "old"))
    tx.mark("pending")
    return tx


def stage(tx: Transaction, changes: DataFrame) -> DataFrame:
    """Writes new texts and backups beside the log. Rows whose text does not change give no operation. A path that comes
    twice fails the transaction: which text should win is not known."""
    place, name = tx.place, tx.id

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, original, modified in zip(f["path"], f["original"], f["modified"]):
                op = hashlib.sha256(path.encode()).hexdigest()
                kind = "create" if original is None else "delete" if modified is None else "modify"
                before = "" if original is None else hashlib.sha256(original.encode()).hexdigest()
                after, backup = "", ""
                if modified is not None:
                    data = modified.encode()
                    after = hashlib.sha256(data).hexdigest()
                    _put(os.path.join(place, "new", op), data)
                if original is not None:
                    backup = os.path.join(place, "old", op)
                    _put(backup, original.encode())
                out.append((name, op, path, kind, before, after, backup, "pending", ""))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in LOG.split(", ")])

    changed = changes.select("path", "original", "modified").filter("not (original <=> modified)")
    changed.mapInPandas(write, LOG).write.parquet(f"file://{place}/ops")
    twice = tx.log().groupBy("path").count().filter("count > 1").select("path").head()
    if twice:
        tx.mark("failed")
        raise TransactionError(f"{twice[0]} is changed twice")
    return tx.log()


def commit(tx: Transaction) -> DataFrame:
    """Moves staged files into place and returns the log with each operation's status. A target whose digest is not the
    staged one any more, or a write that fails, undoes the whole transaction and raises an error."""
    if tx.status() != "pending":
        raise TransactionError(f"{tx.id} is {tx.status()}")
    moved = tx.spark.read.schema(LOG)
    _each(tx.log(), lambda r: _check(r)).write.mode("overwrite").parquet(f"file://{tx.place}/checked")
    bad = moved.parquet(f"file://{tx.place}/checked").filter("status = 'failed'").select("path", "error").head()
    if bad:
        tx.mark("failed")
        raise TransactionError(f"{bad[0]}: {bad[1]}")
    place = tx.place
    _each(tx.log(), lambda r: _move(place, r)).write.mode("overwrite").parquet(f"file://{tx.place}/done")
    bad = tx.log("done").filter("status = 'failed'").select("path", "error").head()
    if bad:
        rollback(tx)
        raise TransactionError(f"{bad[0]}: {bad[1]}; rolled back")
    tx.mark("committed")
    return tx.log("done")


def rollback(tx: Transaction) -> DataFrame:
    """Puts back what the transaction changed: backups where a file was modified or deleted; files that it created go. Files
    that someone has changed since keep that change (status failed)."""
    _each(tx.log(), _undo).write.mode("overwrite").parquet(f"file://{tx.place}/undone")
    tx.mark("rolled_back")
    return tx.log("undone")


def _each(log: DataFrame, act) -> DataFrame:
    """The log with the status and error that ``act`` gives for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            results = []
            for r in f.to_dict("records"):
                try:
                    results.append((act(r), ""))
                except OSError as e:
                    results.append(("failed", str(e)))
                except TransactionError as e:
                    results.append(("failed", str(e)))
            yield f.assign(status=[x for x, _ in results], error=[x for _, x in results])

    return log.mapInPandas(run, LOG)


def _check(r: dict) -> str:
    """Moves of an earlier try of the same task may have been made already."""
    if digest(r["path"]) not in (r["before"], r["after"]):
        raise TransactionError("the file has changed since it was read")
    return "pending"


def _move(place: str, r: dict) -> str:
    path = r["path"]
    if digest(path) == r["after"]:
        return "committed"
    _check(r)
    if r["kind"] == "delete":
        os.remove(path)
        return "committed"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mode = os.stat(path).st_mode & 0o7777 if os.path.exists(path) else None
    with open(os.path.join(place, "new", r["op"]), "rb") as f:
        _put(path, f.read(), mode)
    return "committed"


def _undo(r: dict) -> str:
    now = digest(r["path"])
    if now == r["before"]:
        return "rolled_back"
    if now != r["after"]:
        raise TransactionError("the file has changed since the transaction")
    if r["kind"] == "create":
        os.remove(r["path"])
    else:
        mode = os.stat(r["path"]).st_mode & 0o7777 if now else None
        with open(r["backup"], "rb") as f:
            _put(r["path"], f.read(), mode)
    return "rolled_back"


def transactions(spark: SparkSession, folder: str) -> list[Transaction]:
    """In order of their beginning."""
    return [Transaction(spark, os.path.abspath(folder), name) for name in sorted(os.listdir(folder)) if name.startswith("tx_")] if os.path.isdir(folder) else []


def pending(spark: SparkSession, folder: str) -> list[Transaction]:
    return [t for t in transactions(spark, folder) if t.status() == "pending"]


def cleanup(spark: SparkSession, folder: str, older_than: float) -> int:
    """Removes transactions that are not pending and began over ``older_than`` seconds ago, with their backups."""
    gone = [t for t in transactions(spark, folder) if t.status() != "pending" and time.time() - int(t.id.split("_")[1]) / 1e9 > older_than]
    for t in gone:
        shutil.rmtree(t.place)
    return len(gone)


def summary(log: DataFrame) -> DataFrame:
    """Operations by status."""
    return log.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("n_errors"))


def publish(spark: SparkSession, folder: str, details: DataFrame, backup: bool | str = False, least: float = 0.3, dry_run: bool = False) -> DataFrame:
    """Rewritten documents (doc is the path, original, modified, confidence) written in one transaction.

    One row for each: doc, digests before and after, status (unchanged, dry_run or committed). If a document's score is below
    ``least``, nothing is written and an error tells the first one. backup: the old text stays beside the file as .bak, or,
    if it is "time", as .bak and the second of writing.
    """
    rows = details.select("doc", "original", "modified", F.round("confidence.score", 9).alias("score"))
    report = rows.select("doc", ledger.digest(F.col("original")).alias("before"), ledger.digest(F.col("modified")).alias("after"))
    status = F.when(F.col("before") == F.col("after"), "unchanged")
    if dry_run:
        return report.withColumn("status", status.otherwise("dry_run"))
    changed = rows.filter("original <> modified").select(F.col("doc").alias("path"), "score", F.lit("").alias("error"))
    if low := safety.first_invalid(changed, least).head():
        raise TransactionError(f"{low['path']}: confidence {low['score']:.2f} is below {least:.2f}")
    tx = begin(spark, folder)
    changes = rows.select(F.col("doc").alias("path"), "original", "modified").filter("original <> modified")
    if backup:
        suffix = f".bak.{int(time.time())}" if backup == "time" else ".bak"
        kept = changes.select(F.concat("path", F.lit(suffix)).alias("path"), F.lit(None).cast("string").alias("original"), F.col("original").alias("modified"))
        changes = changes.unionByName(kept)
    stage(tx, changes)
    done = commit(tx).select(F.col("path").alias("doc"), F.col("before"), F.col("after"), F.lit("committed").alias("status"))
    return done
