"""Line dedup by pairwise alignment: overlapping documents are aligned with patience diff, and the later one loses the
blocks that are aligned.

A block is a run of consecutive lines with at least ``min_words`` words (lines without a word do not count as lines).
Every line of it lies in a shortest run that begins or ends with it and has as many words (a line alone, if it has them);
blocks are made of these. Documents meet at rare lines: of lines hashes are counted over all documents, those that one
document alone has end every run, and of each run that is left the rarest line is where its documents meet. Documents that share
frequent lines only have a rarest one of these, too, so that no frequency is a limit. Of those that meet at a line and have
the same run there the earliest is the owner, and every later one pairs with it: pairs of a run are as many as its documents
less one, and each run of a document is aligned in one pair.

In a pair the shared runs, in the order of their places, are aligned with patience diff. What it leaves on both sides has
moved: the first of each that is left in one document is aligned with the first in the other. So each run of the owner is
aligned with one of the later document's, which loses the lines of all that are aligned. What it has more often than the
owner stays, and which of its repeats that is patience diff decides.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from copse.llm.common import HAS_WORD, fresh, in_batches, let, table, written

#: Words of a block that is deleted, at least.
MIN_WORDS = 8
#: Lines of a record batch that Python hands to Spark.
LINES_OF_BATCH = 1 << 14


def _longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails, last, back = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        tails[k : k + 1], last[k : k + 1] = [v], [i]
        back.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j), increasing in both, of equal elements of ``a`` and ``b``: common head and tail, then the longest
    increasing run of elements that are unique in both, then the same between those."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _unique(a, a0, a1), _unique(b, b0, b1)
        both = sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b)
        anchors = [both[k] for k in _longest_increasing([j for _, j in both])]
        at = (a0, b0)
        for i, j in anchors:
            out.append((i, j))
            todo.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
        if anchors:
            todo.append((at[0], a1, at[1], b1))
    return sorted(out)


def _unique(x: list, start: int, end: int) -> dict:
    seen: dict = {}
    for i in range(start, end):
        seen[x[i]] = -1 if x[i] in seen else i
    return {v: i for v, i in seen.items() if i >= 0}


def aligned(shared: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, int, int, bool]]:
    """(place in the later document, place in the owner, size, moved) of the aligned runs, by the first place. shared: of each
    run its size in lines, its places in the later document and in the owner."""
    later = sorted((p, k) for k, (_, own, _) in enumerate(shared) for p in own)
    owner = sorted((p, k) for k, (_, _, other) in enumerate(shared) for p in other)
    pairs = {i: j for i, j in patience([k for _, k in later], [k for _, k in owner])}
    out = [(later[i], owner[j][0], False) for i, j in pairs.items()]
    taken, free = set(pairs.values()), {}
    for j, (p, k) in enumerate(owner):
        if j not in taken:
            free.setdefault(k, []).append(p)
    for i, (p, k) in enumerate(later):
        if i not in pairs and free.get(k):
            out.append(((p, k), free[k].pop(0), True))
    return sorted((p, q, shared[k][0], moved) for (p, k), q, moved in out)


#: Of a line: where it is among those with a word, its hash (128 bits), its words as far as a run needs them.
LINES = "place int, line binary, words int, first boolean"


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k (key), t (hash of the text) and the lines of each row that have a word; first: whether it is the text's first such
    line. Lines are told apart without the white space around them."""
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), *T._parse_datatype_string(f"t long, {LINES}").fields])
    types = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in enumerate(batch.column(2)):
                some = [y for y in map(bytes.strip, x.as_py().split(b"\n")) if y]
                for at in range(0, len(some), LINES_OF_BATCH):
                    part = some[at : at + LINES_OF_BATCH]
                    hashes = [xxhash.xxh3_128_digest(y) for y in part]
                    if at == 0:
                        seen: set[bytes] = set()
                    first = [h not in seen and not seen.add(h) for h in hashes]
                    which = pa.array([row] * len(part), pa.int64())
                    columns = [batch.column(0).take(which), batch.column(1).take(which), range(at, at + len(part)), hashes, [min(min_words, len(y.split(None, min_words))) for y in part], first]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    whole = F.col(f"`{text}`")
    return docs.filter(whole.isNotNull()).select(F.col(f"`{key}`").alias("k"), F.xxhash64(whole).alias("t"), F.encode(whole, "UTF-8").alias("x")).mapInArrow(of, schema)


def runs(lines: list[tuple[int, bytes, int, int]], min_words: int = MIN_WORDS) -> dict[tuple[bytes, bytes], tuple[int, list[int]]]:
    """Of a document's shared lines (place, hash, words, documents that have it) the shortest runs of consecutive ones that have
    ``min_words`` words, from each line on and up to each line: {(rarest line, hash of the run): (lines, places)}."""
    lines = sorted(lines)
    n, found, begin = len(lines), set(), 0
    words = [x[2] for x in lines]
    for stop in range(1, n + 1):
        if stop < n and lines[stop][0] == lines[stop - 1][0] + 1:
            continue
        end, total = begin, 0
        for i in range(begin, stop):
            while end < stop and total < min_words:
                total += words[end]
                end += 1
            if total < min_words:
                break
            found.add((i, end))
            total -= words[i]
        start, total = stop, 0
        for j in range(stop, begin, -1):
            while start > begin and total < min_words:
                start -= 1
                total += words[start]
            if total < min_words:
                break
            found.add((start, j))
            total -= words[j - 1]
        begin = stop
    out: dict[tuple[bytes, bytes], tuple[int, list[int]]] = {}
    for i, j in sorted(found):
        rarest = min(lines[i:j], key=lambda x: (x[3], x[1]))[1]
        run = rarest if j == i + 1 else xxhash.xxh3_128_digest(b"".join(x[1] for x in lines[i:j]))
        out.setdefault((rarest, run), (j - i, []))[1].append(lines[i][0])
    return out


def run_table(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k, t, line (the rarest), run (hash), size (lines) and places of every distinct run of shared lines of each document.
    What one task gathers are a document's own shared lines; counts of lines are combined before they are shuffled."""
    with in_batches(docs.sparkSession):
        lines = written(line_table(docs, key, text, min_words), "lines")
    shared = lines.groupBy("line").agg(F.sum(F.col("first").cast("long")).alias("held")).filter("held > 1")
    of = lines.join(shared, "line").groupBy("k", "t").agg(F.collect_list(F.struct("place", "line", "words", "held")).alias("lines"))
    schema = T.StructType([lines.schema["k"], *T._parse_datatype_string("t long, line binary, run binary, size int, places array<int>").fields])
    types = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, own in enumerate(batch.column("lines")):
                values = own.values
                made = runs(list({*zip(*(values.field(c).to_pylist() for c in ("place", "line", "words", "held")))}), min_words)
                if made:
                    which = pa.array([row] * len(made), pa.int64())
                    columns = [batch.column(0).take(which), batch.column(1).take(which), [x for x, _ in made], [x for _, x in made], [x for x, _ in made.values()], [x for _, x in made.values()]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    with in_batches(docs.sparkSession):
        return written(of.mapInArrow(found, schema), "runs")


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k, t and blocks of each document that shares a run with an earlier one: array of (owner, place, owner_place, size,
    moved), each a run of ``size`` lines that is aligned with the owner's. Places count the lines with a word.

    A document is a key and a text (rows that repeat both are one), and comes before others by key, then by the hash of
    the text. Null keys and texts take no part. What one task gathers is bounded by a document's own lines and their
    places in their owners; owners are minima, combined before the shuffle, and Spark splits the join to them where a run
    is in a third of all rows.
    """
    own = run_table(docs.filter(F.col(f"`{key}`").isNotNull()), key, text, min_words)
    of = own.groupBy("line", "run").agg(F.min(F.struct("k", "t", "places")).alias("first"), F.max(F.struct("k", "t")).alias("last"))
    of = of.filter((F.col("first.k") != F.col("last.k")) | (F.col("first.t") != F.col("last.t")))
    of = written(of.select("line", "run", F.col("first.k").alias("owner"), F.col("first.t").alias("owner_t"), F.col("first.places").alias("other")), "owners")
    met = own.join(of, ["line", "run"]).filter((F.col("k") != F.col("owner")) | (F.col("t") != F.col("owner_t")))
    pairs = met.groupBy("k", "t").agg(F.collect_set(F.struct("owner", "owner_t", "size", "places", "other")).alias("shared"))

    @F.pandas_udf(f"array<struct<owner:{own.schema['k'].dataType.simpleString()},place:int,owner_place:int,size:int,moved:boolean>>")
    def found(shared: pd.Series) -> pd.Series:
        def one(rows: list) -> list[dict]:
            by: dict = {}
            for r in rows:
                by.setdefault((r["owner"], r["owner_t"]), []).append((r["size"], list(r["places"]), list(r["other"])))
            return [{"owner": o, "place": p, "owner_place": q, "size": n, "moved": m} for o, t in sorted(by) for p, q, n, m in aligned(sorted(by[o, t], key=lambda x: x[1]))]

        return shared.map(one)

    return pairs.select("k", "t", found("shared").alias("blocks"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` with its text less the lines of its blocks, and n_deleted, the number of them.

    Documents are ordered by key (of equal keys with different texts, by a hash of the text). Lines without a word stay.
    A null text stays null; a document all of whose lines go has an empty text. Rows with a null key stay as they are.
    Rows equal in key and text are one document and are cut alike. A column n_deleted of ``docs`` gives way. An empty
    table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() != "n_deleted"]
    k, t, gone, parts = fresh([*kept, "n_deleted"], "k", "t", "places", "parts")
    name = lambda c: F.col(f"`{c}`")
    lines_of = F.flatten(F.transform("blocks", lambda b: F.sequence(b["place"], b["place"] + b["size"] - 1)))
    with in_batches(docs.sparkSession):
        marks = written(blocks(docs, key, text, min_words).select(F.col("k").alias(k), F.col("t").alias(t), F.array_distinct(lines_of).alias(gone)), "repeated_lines")
    out = docs.select(*map(name, kept)).join(marks.hint("merge"), (name(key) == F.col(k)) & (F.xxhash64(name(text)) == F.col(t)), "left")  # no bound on marks: never broadcast
    out = out.withColumn(parts, F.when(name(gone).isNotNull(), F.split(name(text), "\n")))
    places = F.sequence(F.lit(0), F.size(parts) - 1)
    with_word = F.filter(places, lambda i: F.get(name(parts), i).rlike(HAS_WORD))
    stay = let(with_word, lambda w: F.array_except(places, F.transform(gone, lambda i: F.get(w, i))))
    cut = F.array_join(F.transform(stay, lambda i: F.get(name(parts), i)), "\n")
    whole = F.when(name(gone).isNotNull(), cut).otherwise(name(text)).alias(text)
    return out.select(*[whole if c == text else name(c) for c in kept], F.coalesce(F.when(name(gone).isNotNull(), F.size(gone)), F.lit(0)).alias("n_deleted"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: lines deleted, and what is left of the text."""
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_deleted", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("text_md5"))
