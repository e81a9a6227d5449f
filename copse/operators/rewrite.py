"""Rewriting matched byte spans of documents: replace, delete, insert before and after, append; diffs.

A document's edits are gathered (they are bounded by the document) and folded from its end to its start over its bytes, in
the order of (start, end) descending, as built-in expressions. Only the diff uses Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.functions import places
from copse.operators import score
from copse.plans.forest import Forest
from copse.selector import Query

METHODS = ("replace", "delete", "insert_before", "insert_after", "append")
EDIT = "struct<start:bigint,end:bigint,new:binary>"


def binary(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def cut(data: Column, start: Column, end: Column) -> Column:
    """Bytes from ``start`` up to ``end`` (0-based); substring on binary counts bytes."""
    return F.substring(data, (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))


def in_order(edits: Column) -> Column:
    return F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["new"].alias("new"))))


def splice(source: Column, edits: Column) -> Column:
    """``source`` (binary) with all edits (a column of start, end, new ``in_order``) made. Edits of nested spans are made
    one after the other, from the last to the first, at the places they had in the source; others join the bytes between
    them, once."""
    rest = lambda a, at: F.substring(a, (at + 1).cast("int"), F.octet_length(a))
    folded = F.aggregate(F.reverse(edits), source, lambda a, e: F.concat(cut(a, F.lit(0).cast("long"), e["start"]), e["new"], rest(a, e["end"])))
    begin = lambda i: F.when(i > 0, F.get(edits, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    pieces = F.transform(edits, lambda e, i: F.hex(F.concat(cut(source, begin(i), e["start"]), e["new"])))  # binary arrays have no join; their digits have
    joined = F.unhex(F.concat(F.array_join(pieces, ""), F.hex(rest(source, F.get(edits, F.size(edits) - 1)["end"]))))
    follows = F.transform(edits, lambda e, i: (i > 0) & ((e["start"] < F.get(edits, i - 1)["end"]) | (e["start"] == F.get(edits, i - 1)["start"])))
    nested = F.exists(follows, lambda y: F.coalesce(y, F.lit(False)))
    return F.when(F.size(edits) == 0, source).when(nested, folded).otherwise(joined)


def transform(forest: Forest, method: str, query: Query, payload: str = "", exported: Column | None = None, invalid: Column | None = None, place=None) -> DataFrame:
    """One row for each document with a match: doc, original, modified, match_count, overlap (spans are nested), confidence.

    Documents without a match give no row, which a batch counts as unchanged. ``append`` writes behind the first match, the
    other methods change every match. exported: a condition on matches; invalid: one on the result's columns; place: a function
    that appends (``append.placing``).
    """
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}")
    found = forest.select(query)
    sources = forest.elements.filter("parent is null").select(F.col("doc").alias("d"), binary(F.col("text")).alias("source"))
    return apply(found, sources, method, query.name, payload, exported, invalid, place)


def apply(found: DataFrame, sources: DataFrame, method: str, name: str, payload: str, exported: Column | None = None, invalid: Column | None = None, place=None) -> DataFrame:
    """``transform`` from matches (doc, start_byte, end_byte, name) and sources (d, source binary)."""
    return apply_all(found, sources, [(method, name, payload)], None, exported, invalid, place)


def apply_all(found: DataFrame, sources: DataFrame, changes: list[tuple[str, str, str]], step: str | None, exported: Column | None = None, invalid: Column | None = None, place=None) -> DataFrame:
    """``apply`` of many changes (method, name, payload) in one plan: ``step`` is the column of ``found`` with the number of
    each match's change, and of the result. Every change is made to the sources as they are."""
    exported = F.lit(False) if exported is None else exported
    spans = F.struct(F.col("start_byte").cast("long").alias("start"), F.col("end_byte").cast("long").alias("end"), exported.alias("exported"), "node_pre")
    by_doc = found.groupBy("doc", *([step] if step else [])).agg(F.array_sort(F.collect_list(spans)).alias("spans"))
    joined = by_doc.join(sources, F.col("doc") == F.col("d")).drop("d")
    source = F.col("source")

    def of_step(value) -> Column:
        """``value`` of the row's change."""
        if len(changes) == 1:
            return value(0)
        out = F.when(F.col(step) == 0, value(0))
        for k in range(1, len(changes)):
            out = out.when(F.col(step) == k, value(k))
        return out

    used = of_step(lambda k: F.slice("spans", 1, 1) if changes[k][0] == "append" else F.col("spans"))

    def changed(s: Column, starts: Column, method: str, _: str, payload: str) -> Column:
        if method == "replace":
            start, end, new = s["start"], s["end"], F.lit(payload)
        elif method == "delete":
            start, end, new = s["start"], s["end"], F.lit("")
        elif method == "insert_before":
            start, end, new = s["start"], s["start"], F.concat(_indent(source, starts, s["start"]), F.lit(payload + "\n"))
        elif method == "insert_after":
            start, end, new = s["end"], s["end"], F.concat(F.lit("\n"), _indent(source, starts, s["start"]), F.lit(payload))
        else:
            start, end, new = s["end"], s["end"], F.lit("\n\n" + payload)
        return F.struct(start.alias("start"), end.alias("end"), binary(new).alias("new"))

    indented = any(m in ("insert_before", "insert_after") for m, *_ in changes)
    starts = places.line_starts(F.decode("source", "UTF-8")) if indented else F.array().cast("array<long>")
    made = joined.withColumn("edits", in_order(places.let(starts, lambda x: F.transform(used, lambda s: of_step(lambda k: changed(s, x, *changes[k]))))))
    made = made.withColumn("result", splice(F.col("source"), F.col("edits")))
    if place and changes[0][0] == "append":
        first = F.get("spans", F.lit(0))
        made = made.withColumn("result", F.coalesce(binary(place(F.decode("source", "UTF-8"), first["start"], first["end"])), F.col("result")))
    nested = F.exists(F.transform(F.col("spans"), lambda s, i: (i > 0) & (s["start"] < F.get(F.col("spans"), i - 1)["end"])), lambda x: F.coalesce(x, F.lit(False)))
    n = F.size("spans")
    made = made.withColumn("invalid", F.lit(False) if invalid is None else invalid)
    c = of_step(lambda k: score.confidence(*changes[k][:2], n, F.get("spans", F.lit(0))["exported"], F.col("invalid"), F.octet_length("source"), F.octet_length("result")))
    return made.select("doc", *([step] if step else []), F.decode("source", "UTF-8").alias("original"), F.decode("result", "UTF-8").alias("modified"), n.cast("long").alias("match_count"), nested.alias("overlap"), c.alias("confidence"))


def _indent(source: Column, starts: Column, start: Column) -> Column:
    """Of the whole line that holds ``start``; starts: where lines start. No more than the line is decoded."""
    line = lambda row: cut(source, F.get(starts, row), F.coalesce(F.get(starts, row + 1) - 1, F.octet_length(source).cast("long")))
    return places.let(places.row_of(starts, start), lambda row: F.regexp_extract(F.decode(line(row), "UTF-8"), r"^[ \t]*", 0))


def append_to_root(forest: Forest, payload: str, place=None) -> DataFrame:
    """Behind the end of every document, or where ``place`` puts it; its confidence is 1."""
    sources = forest.elements.filter("parent is null").select("doc", F.col("text").alias("original"))
    sure = F.struct(F.lit(1.0).alias("score"), F.lit("high").alias("level"), F.array(F.struct(F.lit("append_to_root").alias("name"), F.lit(0.0).alias("impact"), F.lit("nothing is changed").alias("reason"))).alias("factors"))
    plain = F.concat("original", F.lit("\n\n" + payload))
    modified = F.coalesce(place(F.col("original")), plain) if place else plain
    return sources.select("doc", "original", modified.alias("modified"), F.lit(0).cast("long").alias("match_count"), F.lit(False).alias("overlap"), sure.alias("confidence"))


def unified(a: str, b: str, context: int = 3) -> str:
    """Unified diff of two texts by lines. Lines that both begin or end with are set aside first, so that two long texts
    with few changes take no longer than what is between these."""
    import difflib

    if a == b:
        return ""
    x, y = a.split("\n"), b.split("\n")
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i] != y[i]), least)
    tail = next((i for i in range(least - head) if x[-1 - i] != y[-1 - i]), least - head)
    skip, ends = max(0, head - context), max(0, tail - context)  # the context of the changes stays
    lines = list(difflib.unified_diff(x[skip : len(x) - ends], y[skip : len(y) - ends], "original", "modified", n=context, lineterm=""))

    def moved(part: str) -> str:
        sign, start, *size = [part[0], *part[1:].split(",")]
        return sign + ",".join([str(int(start) + skip), *size])

    header = lambda line: f"@@ {' '.join(map(moved, line.split()[1:3]))} @@"
    return "\n".join(header(line) if line.startswith("@@ ") else line for line in lines)


def with_diff(rewritten: DataFrame) -> DataFrame:
    """Adds diff: unified, three lines of context, '' if nothing changed. Line ends are kept apart."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unified(x or "", y or "") for x, y in zip(a, b)], dtype="object")

    return rewritten.withColumn("diff", diff("original", "modified"))
