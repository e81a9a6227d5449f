"""Packing documents into token sequences: exact-complement hashing, then best fit.

Texts are tokenized once, whole, and cut into pieces. What the plan needs of them is the number of pieces of each length,
a table with one row for each length up to the sequence's (2048): it is planned on the driver, whatever the number of
documents. The plan takes lengths from the longest down; the gap that a length leaves is looked up in tables of the sums
of one, two and three lengths, and a combination that fills it exactly is consumed as often as all its lengths are
available. Lengths that no combination completes are packed by best fit. A pattern (lengths of one sequence) is kept with
the number of sequences that follow it. Pieces are then numbered within their length, with hot lengths spread over
several tasks, and find sequence and offset by binary search in the plan.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from copse.llm.common import fresh, in_batches, table, written

LENGTH = 2048
END = 0  # the id after each document
#: Pieces of one length that one task numbers, about; the root of their number if that is more, so that runs stay as few.
RUN = 1024


@functools.cache
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@functools.cache
def _encoders(name: str):
    """Two encodings with the vocabulary and merges of ``name``.json: that for texts with no two white spaces in a row has
    a pattern without look-ahead, which splits them the same and is faster. And the strings of special tokens."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = [tiktoken.Encoding(f"own{i}", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe for i, p in enumerate((public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")))]
    with open(public_tokenizers.path(f"{name}.json"), "rb") as whole:
        special = [t["content"] for t in json.load(whole)["added_tokens"]]
    return *made, special


_RUNS = re.compile(r"\s\s|\s\Z")
#: Longer runs of white space go to the tokenizer itself: tiktoken gives up on one of about a million.
LONG_RUN = 100_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN + 1}}}")


def token_ids(text: str | None, name: str = "byte_bpe_50k") -> np.ndarray:
    """Ids of a whole text as the tokenizer of the library ``tokenizers`` gives them, without special tokens added.

    Texts that hold a special token's string or a long run of white space go to that tokenizer itself; others are encoded
    from the same ranks.
    """
    full, plain, special = _encoders(name)
    text = text or ""
    if any(s in text for s in special) or (len(text) > LONG_RUN and _LONG_RUN.search(text)):
        ids = _tokenizer(name).encode(text, add_special_tokens=False).ids
    else:
        ids = (full if _RUNS.search(text) else plain).encode_ordinary(text)
    return np.array(ids, "<u4")


PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def cut(ids: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, end) of each piece; documents of more than ``length`` ids have full pieces after the first."""
    n = len(ids)
    first = n % length or length
    return [(0, min(first, n))] + [(i, i + length) for i in range(first, n, length)]


def pieces(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``key``, piece, start, length, ids_crc32 and, if asked for, ids. A null text is empty: one
    piece that holds the end id only. The order and number of rows with equal keys are kept apart by their own pieces."""
    fields = [T.StructField(key, docs.schema[key].dataType), *PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]

    schema = T.StructType(fields)
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for row, text_ in enumerate(batch.column(1)):
                ids = np.append(token_ids(text_.as_py(), tokenizer), np.uint32(END)).astype("<u4")
                for i, (a, b) in enumerate(cut(ids, length)):
                    for x, to in zip((row, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype("i4")] if with_ids else [])), rows):
                        to.append(x)
            rows[0] = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([x.cast(t.type) if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(rows, types)], schema=types)

    return docs.select(key, text).mapInArrow(run, schema)


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence) and how many sequences follow each; every piece of ``counts`` is in one.

    Time and size depend on ``length`` alone: each pattern uses up at least one length or is one of best fit's, which go
    by length as well.
    """
    if not all(0 < n <= length for n, c in counts.items() if c):
        raise ValueError("lengths must be from 1 to the sequence's")
    left = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    pairs = np.zeros(2 * length + 1, np.int64)  # of each sum, the pairs of lengths (equal ones too) that are left
    for n in np.flatnonzero(left):
        pairs[n + np.flatnonzero(left[: n + 1])] += 1

    def use(pattern: tuple[int, ...]) -> None:
        need = {n: pattern.count(n) for n in pattern}
        times = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            if left[n] == times * k:
                pairs[n + np.flatnonzero(left)] -= 1
            left[n] -= times * k
        out.append((pattern, times))

    def available(pattern: tuple[int, ...]) -> bool:
        return all(left[n] >= pattern.count(n) for n in pattern)

    def pair(total: int, others: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths of that sum, the longest first, available besides ``others``."""
        if total < 2 or not pairs[total]:
            return None
        short = np.arange(1, total // 2 + 1)
        for a in short[(left[short] > 0) & (left[np.minimum(total - short, length)] > 0) & (total - short <= length)].tolist():
            if available((total - a, a, *others)):
                return total - a, a
        return None

    def complement(n: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap after ``n``."""
        gap = length - n
        if gap and left[gap] and available((gap, n)):
            return (gap,)
        if found := pair(gap, (n,)):
            return found
        longest = np.arange(gap - 2, 0, -1)
        for a in longest[(left[longest] > 0) & (pairs[gap - longest] > 0)].tolist():
            if found := pair(gap - a, (n, a)):
                return (a, *found)
        return None

    if left[length]:
        use((length,))
    for n in np.flatnonzero(left)[::-1].tolist():
        while left[n] and (found := complement(n)):
            use((n, *found))
    # best fit for what is left, from the longest down: bins alike (same lengths) are one entry
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []

    def opened(space: int, pattern: tuple[int, ...], times: int) -> None:
        if space == 0:
            out.append((pattern, times))
            return
        if not open_[space]:
            bisect.insort(spaces, space)
        open_[space].append((pattern, times))

    for n in np.flatnonzero(left)[::-1].tolist():
        c = int(left[n])
        while c:
            i = bisect.bisect_left(spaces, n)
            if i == len(spaces):
                fit = length // n
                if c >= fit:
                    opened(length - fit * n, (n,) * fit, c // fit)
                if c % fit:
                    opened(length - c % fit * n, (n,) * (c % fit), 1)
                break
            space = spaces[i]
            pattern, times = open_[space].pop()
            if not open_[space]:
                spaces.pop(i)
            used = min(c, times)
            if used < times:
                opened(space, pattern, times - used)
            opened(space - n, (*pattern, n), used)
            c -= used
    for x in open_.values():
        out += x
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, offset), by first number: the pieces of the length with numbers
    from it on, up to the next row's, lie at that offset of consecutive sequences."""
    first, taken, rows = 0, defaultdict(int), defaultdict(list)
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows[n].append((taken[n], first, offset))
            taken[n] += times
            offset += n
        first += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def packed(pieces_: DataFrame, length: int = LENGTH, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to every row of ``pieces_`` (which has ``key``, piece, start, length and ids_crc32).

    Two passes over the pieces besides the writing of them: counts by length, and numbers within each length. A length is
    split by a hash into as many runs as its count asks for, so that a length with a third of all pieces is no single
    task's; counts by run shift the numbers of each run.
    """
    (salt, number, ahead) = fresh(pieces_.columns, "run", "number", "ahead")
    counts = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    table_ = slots(plan(counts, length))
    runs = [-(-counts.get(n, 0) // max(RUN, math.isqrt(counts.get(n, 0)))) or 1 for n in range(length + 1)]
    # rows may repeat: their places as they are read tell them apart
    spread = F.pmod(F.xxhash64(key, "piece", "ids_crc32", "start", F.monotonically_increasing_id()), F.get(F.array(*map(F.lit, runs)), F.col("length").cast("int")).cast("long"))
    # without a hot length a run is a length: then rows are dealt by length and a finer hash all the same
    rows = written(pieces_.withColumn(salt, spread), "pieces_by_run")
    by_run = rows.groupBy("length", salt).agg(F.count("*").alias("n"))
    before = by_run.select("length", salt, (F.sum("n").over(W.partitionBy("length").orderBy(salt)) - F.col("n")).alias(ahead))
    before = written(before, "runs")
    order = W.partitionBy("length", salt).orderBy(key, "piece", "start", "ids_crc32")
    rows = rows.withColumn(number, F.row_number().over(order).cast("long") - 1).join(before, ["length", salt])
    rows = rows.select(*pieces_.columns, (F.col(number) + F.col(ahead)).alias(number))
    out = T.StructType([*pieces_.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = (batch.column(c).to_numpy() for c in ("length", number))
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for x in np.unique(n):
                own, at = n == x, table_[int(x)]
                i = np.searchsorted(at[:, 0], k[own], side="right") - 1
                seq[own], off[own] = at[i, 1] + k[own] - at[i, 0], at[i, 2]
            rest = batch.drop_columns([number])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(seq), pa.array(off)], names=[*rest.schema.names, "sequence_id", "offset"])

    return rows.mapInArrow(place, out)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    with in_batches(spark):
        cut_up = written(pieces(docs), "pieces")
    return packed(cut_up).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
