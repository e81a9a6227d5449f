"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = f"file://{tempfile.mkdtemp(prefix='copse-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    _at_exit(spark, where)
    return where


def _at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when Python ends and the session still runs."""

    def drop() -> None:
        context = spark.sparkContext
        if context._jsc is None:
            return
        try:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone by now
            pass

    atexit.register(drop)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the session."""
    path = f"{shared_dir(spark)}/copse-{uuid.uuid4().hex[:12]}/{name}"
    _at_exit(spark, path.rsplit("/", 1)[0])
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives known sizes."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once nothing will read it any more: a long session does not wait for its end."""
    for table in tables:
        context = table.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
