"""Confidence of a rewrite: a score from 0 to 1, a level, and the factors that made it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores below are low, medium; scores are rounded to 1e-9 before they are compared.
LOW, MEDIUM = 0.5, 0.8
REJECTED, RECIPE, AUTO_APPLY = 0.3, 0.85, 0.85


def level(score: Column) -> Column:
    s = F.round(score, 9)
    return F.when(s < LOW, "low").when(s < MEDIUM, "medium").otherwise("high")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def confidence(method: str, name: str, targets: Column, exported: Column, invalid: Column, before: Column, after: Column) -> Column:
    """Struct of score, level and factors. name: the selector's top-level name; targets: their number; exported: whether the
    first is; invalid: whether the result has errors; before and after: sizes in bytes."""
    remove, put = F.lit(method == "delete"), F.lit(method == "replace")
    change = F.abs(after - before) / before
    first = [
        (targets == 1, 0.10, "single_target", "only one match"),
        (targets > 5, -0.30, "multiple_targets", "more than five matches"),
        (remove, -0.10, "delete_operation", "something is deleted"),
        (remove & exported, -0.30, "delete_exported_api", "an exported name is deleted"),
        (put & exported, -0.20, "exported_api", "an exported name is replaced"),
        (F.lit("*" in name), -0.15, "wildcard_pattern", "the name is a pattern"),
    ]
    second = [
        (invalid, -0.40, "post_validation_failed", "the result has syntax errors"),
        (targets > 3, -0.10, "large_target_set", "more than three matches"),
        (F.lit(name.count("*") > 1), -0.10, "broad_wildcard", "the pattern has several wildcards"),
        ((before > 0) & (after > 0) & (change > 0.3), -0.10, "large_size_delta", "the size changes by over 30 %"),
    ]
    add = lambda start, steps: sum((F.when(when, F.lit(x)).otherwise(0.0) for when, x, _, _ in steps), start)
    score = clamp(add(clamp(add(F.lit(1.0), first)), second))
    all_ = F.array(*[F.when(when, F.struct(F.lit(n).alias("name"), F.lit(x).alias("impact"), F.lit(why).alias("reason"))) for when, x, n, why in first + second])
    return F.struct(score.alias("score"), level(score).alias("level"), F.filter(all_, lambda f: f.isNotNull()).alias("factors"))


def rollup(details: DataFrame, by: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """One row for a batch (for each value of ``by``, with the aggregates ``more``), from modified, score and error ('' if none) of its files: score, level, files_modified.

    The mean of modified files without errors, less 0.2 if a file has an error, 0.1 if one of them is below 0.7 and 0.1 if
    over ten are modified; 0 if none is.
    """
    good = F.col("modified") & (F.coalesce("error", F.lit("")) == "")
    score = F.when(good, F.col("score"))
    a = details.groupBy(*by).agg(F.avg(score).alias("mean"), F.count(score).alias("n"), F.coalesce(F.min(score), F.lit(1.0)).alias("least"), F.coalesce(F.max((F.coalesce("error", F.lit("")) != "").cast("int")), F.lit(0)).alias("errors"), *more)
    others = [c for c in a.columns if c not in (*by, "mean", "n", "least", "errors")]
    minus = lambda when, x: F.when(when, x).otherwise(0.0)
    total = clamp(F.col("mean") - minus(F.col("errors") > 0, 0.2) - minus(F.col("least") < 0.7, 0.1) - minus(F.col("n") > 10, 0.1))
    out = a.select(*by, F.coalesce(F.when(F.col("n") > 0, total), F.lit(0.0)).alias("score"), F.col("n").alias("files_modified"), *others)
    return out.withColumn("level", level(F.col("score")))
