"""Safety limits, integrity checks and transactions over snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Error codes (fixed values).
FILE_COUNT, FILE_SIZE, CONFIDENCE, INTEGRITY = 11002, 11003, 11004, 11005


@dataclass(frozen=True)
class Limits:
    """0 is no limit. mode: per_file, global (the batch's mean) or both."""

    max_files: int = 1000
    max_file_size: int = 10 << 20
    max_total_size: int = 100 << 20
    mode: str = "per_file"
    per_file: float = 0.0
    overall: float = 0.0


def validate(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each batch of ``files`` (batch, size, confidence): sums and the code of the first limit broken, or 0."""
    a = files.groupBy("batch").agg(F.count("*").alias("n_files"), F.max("size").alias("largest"), F.sum("size").alias("total"), F.min("confidence").alias("least"), F.avg("confidence").alias("mean"))
    over = lambda c, x: F.lit(bool(x)) & (F.col(c) > x)
    code = F.when(over("n_files", limits.max_files), FILE_COUNT).when(over("largest", limits.max_file_size), FILE_SIZE).when(over("total", limits.max_total_size), FILE_SIZE)
    if limits.mode in ("per_file", "both"):
        code = code.when(F.round("least", 9) < limits.per_file, CONFIDENCE)
    if limits.mode in ("global", "both"):
        code = code.when(F.round("mean", 9) < limits.overall, CONFIDENCE)
    return a.withColumn("code", code.otherwise(0))


def integrity(now: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths of ``expected`` (path, expected_hash) whose hash in ``now`` (path, hash) is another; unknown paths pass."""
    joined = expected.join(now, "path")
    return joined.filter(F.col("hash") != F.col("expected_hash")).withColumn("code", F.lit(INTEGRITY))


def first_invalid(details: DataFrame, least: float = 0.3) -> DataFrame:
    """The first file by path that has an error or too little confidence, if any: what fails a batch."""
    bad = details.filter((F.coalesce("error", F.lit("")) != "") | (F.round("score", 9) < least))
    return bad.orderBy("path").limit(1)
