"""Recipes: named steps over a set of documents, each previewed, gated by its confidence and then applied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators import rewrite, score
from copse.plans.forest import Forest
from copse.selector import Query, choose

DEFAULT = 0.85


class RecipeError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    name: str
    method: str
    target: Query
    payload: str = ""
    min_confidence: float | None = None


def validated(spec: dict) -> tuple[list[Step], float]:
    """Steps and threshold of a recipe's JSON object."""
    if not spec.get("name") or not spec.get("steps"):
        raise RecipeError("a recipe needs a name and steps")
    steps = []
    for s in spec["steps"]:
        if s.get("method") not in rewrite.METHODS:
            raise RecipeError(f"unsupported method {s.get('method')!r}")
        has_type = bool((s.get("target") or {}).get("type"))
        if not (has_type or s.get("dsl") or s["method"] == "append"):
            raise RecipeError(f"step {s.get('name')!r} needs a target type")
        target = choose(s.get("dsl"), s.get("target")) if s.get("dsl") or s.get("target") else Query()
        steps.append(Step(s.get("name", ""), s["method"], target, s.get("replacement") or s.get("content") or "", s.get("min_confidence")))
    return steps, spec.get("min_confidence") or DEFAULT


def details(forest: Forest, step: Step) -> DataFrame:
    return rewrite.append_to_root(forest, step.payload) if step.method == "append" and not step.target.kind else rewrite.transform(forest, step.method, step.target, step.payload)


def totals(forest: Forest, step: Step, k: int, failed: DataFrame | None = None) -> DataFrame:
    """One row: what the step scans, modifies and matches, and the score of it all. failed: documents (doc, error) that could
    not be read; they count as scanned, and against the score."""
    return preview(forest, [step], failed, k)


def preview(forest: Forest, steps: list[Step], failed: DataFrame | None = None, first: int = 1) -> DataFrame:
    """A dry run: every step against the documents as they are, a row for each (numbered from ``first``). The matches of all steps
    are found in one pass over the elements and meet their documents once."""
    whole = [k for k, s in enumerate(steps) if s.method == "append" and not s.target.kind]
    some = [k for k in range(len(steps)) if k not in whole]
    sources = forest.elements.filter("parent is null").select(F.col("doc").alias("d"), rewrite.binary(F.col("text")).alias("source"))
    parts = [rewrite.append_to_root(forest, steps[k].payload).withColumn("step", F.lit(k)) for k in whole]
    if some:
        found = forest.select_all([steps[k].target for k in some])
        number = F.get(F.array(*map(F.lit, some)), F.col("step"))
        parts.append(rewrite.apply_all(found, sources, [(steps[k].method, steps[k].target.name, steps[k].payload) for k in some], "step").withColumn("step", number))
    each = [p.select("step", (F.col("modified") != F.col("original")).alias("modified"), F.col("confidence.score").alias("score"), F.lit("").alias("error"), "match_count") for p in parts]
    every = F.explode(F.array(*[F.lit(k) for k in range(len(steps))])).alias("step")
    if failed is not None:
        each.append(failed.select(every, F.lit(False).alias("modified"), F.lit(None).cast("double").alias("score"), "error", F.lit(0).cast("long").alias("match_count")))
    details_ = reduce(DataFrame.unionByName, each)
    # a row of nothing for each step, so that those without a match have one, too
    scanned = forest.elements.filter("parent is null").select(F.col("doc").cast("string"))
    scanned = (scanned if failed is None else scanned.union(failed.select(F.col("doc").cast("string")))).agg(F.count("*").alias("scanned"))
    none = scanned.select(every, F.lit(False).alias("modified"), F.lit(None).cast("double").alias("score"), F.lit("").alias("error"), F.lit(0).cast("long").alias("match_count"), "scanned")
    details_ = details_.withColumn("scanned", F.lit(None).cast("long")).unionByName(none)
    sums = (F.max("scanned").alias("scanned"), F.count_if("modified").alias("modified"), F.sum("match_count").alias("matches"))
    out = score.rollup(details_, ("step",), sums)
    names = F.array(*[F.lit(s.name) for s in steps])
    return out.select(F.get(names, F.col("step")).alias("step"), (F.col("step") + first).alias("k"), "scanned", "modified", "matches", "score", "level")


def execute(forest: Forest, steps: list[Step], publish: Callable[[DataFrame, Step], Forest] | None = None, threshold: float = DEFAULT) -> list[dict]:
    """Steps in order. Each is previewed (one small row comes to the driver); a score below the step's or the recipe's
    threshold ends the recipe with an error, and what earlier steps have published stays. ``publish`` gets the rewritten
    documents and gives the forest that the next step reads; without it this is a dry run."""
    done = []
    for k, step in enumerate(steps, 1):
        row = totals(forest, step, k).first().asDict()
        least = threshold if step.min_confidence is None else step.min_confidence
        if (row["modified"] or row["matches"]) and round(row["score"], 9) < least:
            raise RecipeError(f"step {step.name!r}: confidence {row['score']:.2f} is below {least:.2f}")
        if publish:
            forest = publish(details(forest, step), step)
        done.append(row)
    return done
