"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copse.sources.shared import discard, shared_dir, shared_path, written

__all__ = ["among", "discard", "fresh", "in_batches", "let", "numbered", "shared_dir", "shared_path", "table", "words", "written"]
#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
#: A character of a word.
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Rows of a batch that whole texts or sets of hashes go to Python in.
BATCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for each row and hand it to ``body``.

    A lambda variable holds the value, so that lambdas inside ``body`` do not evaluate its expression for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


@contextlib.contextmanager
def in_batches(spark: SparkSession, rows: int = BATCH) -> Iterator[None]:
    """Actions within hand at most so many rows at a time to Python, which bounds the memory of both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Keys that are broadcast, at most: a few MB.
KEYS = 1 << 17


def among(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``keys`` (how: left_semi) or not (left_anti; nulls stay). ``keys`` is a written
    table of that column: it is counted, broadcast if there are ``KEYS`` or fewer, and merged with ``df`` by key if more."""
    few = keys.limit(KEYS + 1).count() <= KEYS and keys.schema[on].dataType.typeName() not in ("string", "binary")
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names as close to ``names`` as those already taken (compared without case) allow."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with group_id (a long for each value of ``group``, null ones included), pos (from 0, by ``order``, nulls first)
    and n (rows of the group); and the groups themselves: ``group``, group_id, n.

    Rows are dealt by ranges of group and order, so that a group with a third of all rows is many tasks'; their numbers
    within a task come with the sorted rows, and one row for each group and task says what lies before. ``order`` has to
    tell all rows apart, or else a range of equal rows is one task's. ``rows`` is a written table. The columns group_id,
    pos, n, task and at of ``rows`` give way.
    """
    spark = rows.sparkSession
    taken = [*group, "group_id", "pos", "n", "task", "at"]
    carried = [c for c in rows.columns if c.lower() not in taken[len(group):]]
    quoted = lambda names: [F.col(f"`{c}`") for c in names]
    keys = [c.asc_nulls_first() for c in quoted([*group, *order])]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*quoted(carried)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), name)
    of = dealt.groupBy("task", *quoted(group)).agg(F.min("at").alias("at"), F.count("*").alias("n"))
    whole = W.partitionBy(*quoted(group))
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of = of.select("task", *quoted(group), "at", before.alias("before"), F.min("at").over(whole).alias("group_id"), F.sum("n").over(whole).alias("n"))
    of = written(of, f"{name}_tasks")
    own = dict(zip(group, fresh([*carried, "before", "first", "of_task", *taken], *(f"of_{c}" for c in group))))
    starts = of.select(F.col("task").alias("of_task"), F.col("at").alias("first"), "before", "group_id", "n", *[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    same = F.col("task") == F.col("of_task")
    for c, x in own.items():
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`{x}`"))
    out = dealt.join(starts, same).select(*quoted(carried), "group_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")
    return out, of.select(*quoted(group), "group_id", "n").distinct()
