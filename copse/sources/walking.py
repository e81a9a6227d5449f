"""Folders of a file system that executors share, listed level by level by tasks.

Each level's folders are opened where Spark puts them; what they hold is a table, of which excluded folders, those too deep
and those that were met before (by device and inode, where links are followed) are taken out before anything of them is
opened. So a pruned tree costs what is left of it, cycles end, and the driver only learns whether there is another level.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from copse.functions import patterns
from copse.sources import shared

ENTRIES = "folder string, path string, kind string, link boolean, device long, inode long, size long, mod_time long, stamp long, error string"
#: Bytes of files that are handed to Spark at once, about.
BATCH = 8 << 20


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def _opened(root: str, follow: bool):
    """A function on folders (path, relative to ``root``) that gives their entries; a folder that cannot be read is one entry
    with an error."""
    schema = _arrow(ENTRIES)

    def one(folder: str) -> Iterator[tuple]:
        try:
            with os.scandir(os.path.join(root, folder) if folder else root) as found:
                for e in found:
                    path = f"{folder}/{e.name}" if folder else e.name
                    try:
                        info = e.stat(follow_symlinks=follow)
                        kind = "folder" if e.is_dir(follow_symlinks=follow) else "file"
                        yield folder, path, kind, e.is_symlink(), info.st_dev, info.st_ino, info.st_size, int(info.st_mtime), info.st_mtime_ns, None
                    except OSError as x:  # a link to nothing, or gone since
                        yield folder, path, "none", e.is_symlink(), None, None, None, None, None, str(x)
        except OSError as x:
            yield folder, folder, "unread", False, None, None, None, None, None, str(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = list(one(folder))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return run


def entries(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), max_depth: int = 0, follow: bool = False) -> DataFrame:
    """All entries of ``root`` and below (``ENTRIES``; kind: folder, file, none for a link to nothing, unread for a folder that
    cannot be opened), as one written table for each level. Entries that ``exclude`` matches are left out with all that is
    below. 0 is no limit of depth; the root's own entries have depth 0.

    Links are left out, or followed (``follow``): then a folder that several paths reach is opened once, on the first level and
    there by the first path; the root itself counts as met.
    """
    info = os.stat(root)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = spark.createDataFrame([("",)], "path string")
    met = spark.createDataFrame([(info.st_dev, info.st_ino)], "device long, inode long")
    levels, depth = [], 0
    while True:
        # by a hash, so that folders next to each other are not one task's
        found = frontier.select("path").repartition(parts, "path").mapInArrow(_opened(root, follow), ENTRIES)
        for glob in exclude:
            found = found.filter((F.col("path") == "") | ~patterns.glob_matches(F.col("path"), glob))
        found = found if follow else found.filter("not link")
        level = shared.written(found, f"level_{depth}")
        levels.append(level)
        depth += 1
        folders = level.filter("kind = 'folder'")
        if follow:
            folders = folders.join(met, ["device", "inode"], "left_anti").groupBy("device", "inode").agg(F.min("path").alias("path"))
        if (max_depth and depth > max_depth) or folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        frontier = shared.written(folders.select("path", "device", "inode"), f"folders_{depth}")
        met = met.unionByName(frontier.select("device", "inode"))


def read(found: DataFrame, root: str, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``found`` (which has path), content and error of each file: a file that cannot be read has a null
    content and says why. What a task holds is a batch of files."""
    schema = T.StructType([*[found.schema[c] for c in kept], T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, contents, errors, size = [], [], [], 0

            def made() -> pa.RecordBatch:
                own = batch.take(pa.array(rows, pa.int64()))  # noqa: B023
                return pa.RecordBatch.from_arrays([*[own.column(c) for c in kept], pa.array(contents, pa.binary()), pa.array(errors, pa.string())], schema=types)  # noqa: B023

            for i, path in enumerate(batch.column("path").to_pylist()):
                content, error = None, None
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read()
                except OSError as x:
                    error = str(x)
                rows.append(i)
                contents.append(content)
                errors.append(error)
                size += len(content or b"")
                if size >= BATCH:
                    yield made()
                    rows, contents, errors, size = [], [], [], 0
            if rows:
                yield made()

    return found.select(*kept, *(["path"] if "path" not in kept else [])).mapInArrow(run, schema)
