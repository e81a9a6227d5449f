"""Places in texts: rows and columns of byte offsets, by search in an index of line starts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda inside ``body`` would evaluate a column's expression for each
    of its elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column, block: int = 256) -> Column:
    """The running sums of an array of longs. An array grows by copying, so sums are made within blocks and over them."""
    zero = F.lit(0).cast("long")
    sums = lambda x: F.slice(F.aggregate(x, F.array(zero), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))), F.lit(2), F.greatest(F.lit(1), F.size(x)))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda k: k * block + 1)
    parts = F.transform(starts, lambda at: sums(F.slice(sizes, at, F.lit(block))))
    before = lambda p: F.concat(F.array(zero), sums(F.transform(p, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), zero))))
    shifted = lambda p: F.get(F.transform(F.array(before(p)), lambda b: F.flatten(F.transform(p, lambda x, k: F.transform(x, lambda n: n + F.get(b, k))))), F.lit(0))
    return F.get(F.transform(F.array(parts), shifted), F.lit(0))


def line_starts(text: Column) -> Column:
    """Byte offsets at which the lines of a text start, ascending; a null text is empty and has one line."""
    sizes = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.octet_length(x).cast("long") + 1)
    return let(running(sizes), lambda ends: F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.size(ends) - 1)))


def row_of(starts: Column, at: Column, steps: int = 32) -> Column:
    """How many of the ascending ``starts`` are at or before ``at``, less one: found by halving, in 2 ** steps of them at most."""
    begin = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    goes_up = lambda s: F.get(starts, middle(s)) <= at

    def halve(s: Column, _: Column) -> Column:
        done = s["high"] - s["low"] <= 1
        return F.struct(F.when(~done & goes_up(s), middle(s)).otherwise(s["low"]).alias("low"), F.when(~done & ~goes_up(s), middle(s)).otherwise(s["high"]).alias("high"))

    # as many steps as the number of starts asks for
    needed = F.sequence(F.lit(1), F.least(F.lit(steps), F.ceil(F.log2(F.size(starts) + F.lit(1))).cast("int") + 1))
    return F.aggregate(needed, begin, halve, lambda s: s["low"])


def place(starts: Column, at: Column) -> Column:
    """row and col (bytes from the start of the row), both from 0, of a byte offset."""
    return let(row_of(starts, at), lambda r: F.struct(r.alias("row"), (at - F.get(starts, r)).cast("int").alias("col")))
