"""What this package can do, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.operators.rewrite import METHODS
from copse.selector import SYMBOLS


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [("operator", s) for s in SYMBOLS] + [("method", m) for m in METHODS]
    rows += [("attribute", a) for a in ("text", "source", "arg", "argN", "before", "after", "type")]
    return spark.createDataFrame(rows, "category string, name string")


def used(stages: DataFrame) -> DataFrame:
    """All capabilities, with the number of ``stages`` (operation) that each method was used for; 0 for all else."""
    counts = stages.groupBy(F.col("operation").alias("name")).agg(F.count("*").alias("n"))
    found = capabilities(stages.sparkSession).join(counts, "name", "left")
    return found.select("category", "name", F.when(F.col("category") == "method", F.coalesce("n", F.lit(0))).otherwise(0).alias("n"))
