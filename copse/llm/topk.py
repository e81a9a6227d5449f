"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Components are whole numbers. The index is a table of blocks of vectors. A block has one posting for each component of each
vector (its place and its impact, the component quantised to fourteen bits and a sign), in segments by descending impact.
Queries take segment after segment: a posting adds the query's component times its impact to its vector's score. For every
vector and segment the index holds the length of what the segments up to there leave of the vector (components not yet
met, and what quantising cut off). Times the query's length it bounds how far the score is off (Cauchy-Schwarz), which
proves which vectors can be among the best k; once these are few, processing stops, and they are scored exactly with their
whole components.

The first block of each length gives every query a score that its k-th best reaches at least. All other blocks are asked
with that threshold: a block whose largest and smallest components cannot reach it is skipped without its postings being
read, and in the others it cuts the members down sooner than the block's own scores could.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from copse.llm.common import in_batches, table, written

#: Vectors of a block, and queries of a part, at most; fewer of long vectors, so that either has so many components, about.
BLOCK = QUERIES = 4096
COMPONENTS = 1 << 18
#: Bits of an impact, and the segments by descending impact: each ends with the last impact that so large a share of the
#: postings reaches (equal impacts are never parted).
BITS = 14
SEGMENTS = (0.2, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.93, 1.0)
#: Tasks that meeting parts and blocks are dealt to, at most, and pairs of them that go to Python at a time.
TASKS, MET = 1024, 2
#: Queries whose scores of a block are held at a time.
ASKED = 128
#: Of a vector's length, so large a share may be lost to rounding by an operation on floats.
ROUNDING = 2.0**-23


def quantised(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component as long; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(F.lit(float(factor)) * v).cast("long")))


class Postings:
    """Postings of one block. slots: vector * dimensions + dimension; impacts: signed, in quanta; both by segment and then by
    dimension; ends: of each segment; left: for each segment and vector the length of what is left of it, in quanta.
    A component v with impact i is taken for sign(v) * (|i| + half of what a quantum leaves open), for 0 if its impact is 0."""

    def __init__(self, shape: tuple[int, int], quantum: int, slots: np.ndarray, impacts: np.ndarray, ends: np.ndarray, left: np.ndarray) -> None:
        self.shape, self.quantum, self.slots, self.impacts, self.ends, self.left = shape, quantum, slots, impacts, ends, left.reshape(len(ends), shape[0])
        self.read = 0  # postings times queries, so far

    @classmethod
    def of(cls, vectors: np.ndarray) -> Postings:
        flat, (n, dims) = vectors.ravel(), vectors.shape
        size = np.abs(np.maximum(flat, np.iinfo(np.int64).min + 1))  # the smallest long has no absolute value
        quantum = 1 << max(0, int(size.max(initial=0)).bit_length() - BITS)
        size = size // quantum
        order = np.argsort(-size, kind="stable")
        ends = np.unique(np.searchsorted(-size[order], [-size[order[max(0, int(x * len(size)) - 1)]] for x in SEGMENTS], side="right"))
        segment = np.empty(len(size), np.int64)
        segment[order] = np.searchsorted(ends, np.arange(len(size)), side="right")
        slots = np.lexsort((np.arange(len(size)), np.arange(len(size)) % dims, segment))
        impacts = np.where(flat < 0, -size, size)
        exact = vectors / quantum
        rest, taken, segment = exact, cls._taken(impacts, quantum).reshape(n, dims), segment.reshape(n, dims)
        rounded = np.sqrt((exact * exact).sum(1)) * (dims + 8) * ROUNDING
        left = []
        for k in range(len(ends)):
            rest = np.where(segment == k, exact - taken, rest)
            left.append(np.sqrt((rest * rest).sum(1)) + rounded)
        return cls((n, dims), quantum, slots.astype(np.int32), impacts[slots].astype(np.int16), ends.astype(np.int32), np.nextafter(np.array(left, np.float32), np.float32(np.inf)))

    @staticmethod
    def _taken(impacts: np.ndarray, quantum: int) -> np.ndarray:
        return impacts + np.sign(impacts) * ((quantum - 1) / (2 * quantum))

    def members(self, queries: np.ndarray, k: int, floor: np.ndarray) -> list[np.ndarray]:
        """For each query (doubles) the rows of all vectors that can be among its ``k`` best and score ``floor`` or more."""
        n, dims = self.shape
        if not len(queries):
            return []
        length = np.sqrt((queries * queries).sum(1)) * self.quantum  # scores here are shares of it
        length[length == 0] = 1
        by_dim = np.ascontiguousarray((queries / (length / self.quantum)[:, None]).T.astype(np.float32))
        floor = (floor / length).astype(np.float32)
        floor = floor - np.abs(floor) * np.float32(8 * ROUNDING)
        rows, dim, values = self.slots // dims, self.slots % dims, self._taken(self.impacts, self.quantum).astype(np.float32)
        score, begin = np.zeros((n, len(queries)), np.float32), 0
        added, met = np.empty_like(score), np.empty_like(score)
        for end, left in zip(self.ends.tolist(), self.left):
            cuts = begin + np.searchsorted(dim[begin:end], np.arange(dims + 1))
            for d in range(dims):
                at = rows[cuts[d] : cuts[d + 1]]  # a vector has one posting of a dimension
                if len(at):
                    np.multiply(values[cuts[d] : cuts[d + 1], None], by_dim[d], out=added[: len(at)])
                    score.take(at, axis=0, out=met[: len(at)], mode="clip")
                    score[at] = np.add(added[: len(at)], met[: len(at)], out=met[: len(at)])
            self.read += (end - begin) * len(queries)
            ahead, begin = int(self.ends[-1]) - end, end
            if 2 * ahead > n * dims:
                continue  # too early for a proof
            reached = floor
            if n >= k and not np.isfinite(floor).all():
                reached = np.maximum(floor, np.partition(score - left[:, None], n - k, axis=0)[n - k])
            hits = score + left[:, None] >= reached
            if hits.sum() * dims <= ahead * len(queries) // 4 or not ahead:  # scoring them takes less than going on
                break
        return [np.flatnonzero(h) for h in hits.T]


def _safe(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether longs hold every sum of products."""
    largest = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return largest(queries) * largest(vectors) * max(1, vectors.shape[1]) < 1 << 63


def top_of_block(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None, postings: Postings | None = None) -> Iterator[tuple[int, int, int]]:
    """(place of the query, vector id, score) of the ``k`` best vectors for each query that score its ``floor`` or more, its
    own id left out, ties to the smaller id. A score that no long holds is the largest or smallest long."""
    own = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # so many rows may have the query's id
    postings = postings or Postings.of(vectors)
    floor = np.full(len(qids), -np.inf) if floor is None else floor
    # nothing of a block reaches a query's floor if its largest and smallest components do not
    most, least, doubles = vectors.max(0).astype(np.float64), vectors.min(0).astype(np.float64), queries.astype(np.float64)
    reach = np.maximum(doubles * most, doubles * least).sum(1) + ROUNDING * (np.abs(doubles) * np.maximum(np.abs(most), np.abs(least))).sum(1)
    some = np.flatnonzero(reach >= floor)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    plain = _safe(queries, vectors)
    for at in range(0, len(some), ASKED):
        part = some[at : at + ASKED]
        for i, rows in zip(part, postings.members(doubles[part], k + own, floor[part])):
            if not plain:  # all that are beyond a long are alike
                rows = np.union1d(rows, np.flatnonzero(np.abs(vectors.astype(np.float64) @ doubles[i]) >= 2.0**63 * (1 - 1e-6)))
            rows = rows[ids[rows] != qids[i]]
            if plain:
                scores = vectors[rows] @ queries[i]
            else:
                exact = vectors[rows].astype(object) @ queries[i].astype(object)
                scores = np.array([min(max(x, low), high) for x in exact], np.int64)
            order = np.lexsort((ids[rows], ~scores))[:k]  # ~x is -x - 1, which every long has
            for j in order:
                yield int(i), int(ids[rows[j]]), int(scores[j])


#: A block of the index: ids, vectors one after the other, and its postings.
INDEX = "n int, block long, ids array<long>, vectors array<long>, quantum long, slots array<int>, impacts array<short>, ends array<int>, left array<float>"


def index(rows: DataFrame) -> DataFrame:
    """Blocks (``INDEX``) of rows (n, block, id, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, block, ids, flat in batch[["n", "block", "id", "v"]].itertuples(index=False):
                p = Postings.of(np.asarray(flat, np.int64).reshape(len(ids), n))
                yield pd.DataFrame({"n": [n], "block": [block], "ids": [ids], "vectors": [flat], "quantum": [p.quantum], "slots": [p.slots], "impacts": [p.impacts], "ends": [p.ends], "left": [p.left.ravel()]})

    return _gathered(rows, ("n", "block"), ("id",)).mapInPandas(run, INDEX)


def meeting(lengths: DataFrame, queries: DataFrame, blocks: DataFrame, some: Column) -> DataFrame:
    """A row for each part of the queries (query, id, floor, v) and each block of their length that ``some`` picks.

    Both joins are merges. Parts and blocks are few rows of megabytes in small files, and the pairs come from a small table:
    by the sizes that Spark sees it would send any of them through the driver to all executors.
    """
    # the pairs that meet are rows of their own, so that one length is as many keys as it has pairs
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    meet = lengths.filter("blocks > 0").select("n", "parts", numbers("blocks").alias("block")).filter(some).select("n", "block", numbers("parts").alias("part"))
    met = meet.join(_gathered(queries, ("n", "part"), ("query", "id", "floor")).hint("merge"), ["n", "part"])
    return met.join(blocks.filter(some).hint("merge"), ["n", "block"]).drop("block", "part")


def _gathered(rows: DataFrame, by: tuple[str, ...], each: tuple[str, ...]) -> DataFrame:
    """Arrays of ``each`` and v (one vector after the other) of the rows of each block."""
    found = rows.groupBy(*by).agg(F.collect_list(F.struct(*each, "v")).alias("rows"))
    return found.select(*by, *[F.col(f"rows.{x}").alias(x) for x in each], F.flatten("rows.v").alias("v"))


FOUND = "query long, query_id long, vec_id long, score long"


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each row that ``is_query`` picks.

    Rows whose vector is null or holds null or non-finite components, or whose key is null, take no part, and neither do
    vectors of another length than the query's, however many lengths there are. A row with the query's own key is no
    candidate of it. Rows that repeat a key are candidates each, and queries each, with ranks of their own, unless they
    repeat the vector, too. With fewer candidates all are given. Scores beyond a long count as the largest or smallest one.
    Blocks of rows are dealt by a hash of key and place, never by the vector, so that one common vector is spread; every
    part of the queries meets every block of their length.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), factor).alias("v"), is_query.alias("q")).filter("id is not null and v is not null and size(v) > 0")
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("n"), F.coalesce("q", F.lit(False)).alias("q")), "quantised")
    share = lambda count, most: F.ceil(F.col(count) / F.least(F.lit(most), F.greatest(F.lit(64), F.floor(F.lit(COMPONENTS) / F.col("n"))))).cast("long")
    lengths = rows.groupBy("n").agg(F.count("*").alias("c"), F.count_if("q").alias("asked")).filter("asked > 0")
    lengths = written(lengths.select("n", share("c", BLOCK).alias("blocks"), share("asked", QUERIES).alias("parts")), "lengths")
    blocked = rows.join(lengths, "n").select("id", "v", "n", F.pmod(F.xxhash64("id", "row"), F.col("blocks")).alias("block"))
    with in_batches(vectors.sparkSession, MET):
        blocks = written(index(blocked), "index")
    asked = rows.filter("q").groupBy("id", "v", "n").agg(F.min("row").alias("query")).join(lengths, "n")
    asked = written(asked.select("query", "id", "v", "n", F.pmod(F.xxhash64("query"), F.col("parts")).alias("part")), "queries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                of = lambda flat, ids: np.asarray(flat, np.int64).reshape(len(ids), r.n)  # noqa: E731, B023
                number, qids, ids = (np.asarray(x, np.int64) for x in (r.query, r.id, r.ids))
                postings = Postings((len(ids), r.n), r.quantum, r.slots, r.impacts, r.ends, r.left)
                found = np.array(list(top_of_block(qids, of(r.v, qids), ids, of(r.vectors, ids), k, np.asarray(r.floor, np.float64), postings)), np.int64).reshape(-1, 3)
                yield pd.DataFrame({"query": number[found[:, 0]], "query_id": qids[found[:, 0]], "vec_id": found[:, 1], "score": found[:, 2]})

    def ask(with_floor: DataFrame, some: Column, name: str) -> DataFrame:
        met = meeting(lengths, with_floor, blocks, some).repartition(min(TASKS, max(16, pairs // 4)))
        with in_batches(vectors.sparkSession, MET):
            return written(met.mapInPandas(run, FOUND), name)

    pairs = lengths.agg(F.coalesce(F.sum(F.col("blocks") * F.col("parts")), F.lit(0))).first()[0]
    first = ask(asked.withColumn("floor", F.lit(float("-inf"))), F.col("block") == 0, "first_block")
    floors = first.groupBy("query").agg(F.count("*").alias("found"), (F.min("score").cast("double") * (1 - F.signum(F.min("score").cast("double")) * ROUNDING)).alias("floor")).filter(F.col("found") >= k)
    sure = asked.join(floors.select("query", "floor").hint("merge"), "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = first.unionByName(ask(sure, F.col("block") > 0, "other_blocks"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for every row whose vec_id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
