"""Mixing sources to target weights: Poisson replication.

A document of a source is repeated as often as a Poisson draw says whose mean is the source's target repetition rate:
the target size of the source over its size in the corpus. The draw inverts the distribution at a number that a hash of
seed and document gives, so that it is the same in every run and on every executor. Copies are then dealt over all
partitions by another hash and sorted by it within each: a global shuffle in one exchange. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import fresh, table

#: Target share of each source in the mix. Sources that are not listed keep a rate of 1.
WEIGHTS = {f"src{i}": 0.1 if i == 0 else 0.9 / 19 for i in range(20)}


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits from the MD5 of ``parts``."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_tables(rates: dict[str, float]) -> dict[str, tuple[int, list[float]]]:
    """For each source a count and the distribution function from that count on, up to where it is 1 in double precision.
    Rates over 600 start where the distribution is no longer 0 in double precision."""
    out = {}
    for source, rate in rates.items():
        first, term = 0, math.exp(-rate)
        if rate > 600:
            first = max(0, int(rate - 12 * math.sqrt(rate)))
            term = math.exp(first * math.log(rate) - rate - math.lgamma(first + 1))
        total, table_, k = term, [term], first
        while k < rate or term > 1e-18:
            k += 1
            term *= rate / k
            total += term
            table_.append(total)
        out[source] = first, table_
    return out


def rates_of(docs: DataFrame, weights: dict[str, float], total: float | None = None, source: str = "source", text: str = "text") -> dict[str, float]:
    """Repetition rate of each listed source that has text: its target bytes over its bytes.

    One pass with partial sums; what comes to the driver has as many rows as ``weights`` has sources at most.
    ``total``: bytes of the mix, the bytes of the listed sources if not given.
    """
    size = F.sum(F.octet_length(F.coalesce(F.col(text), F.lit("")))).alias("b")
    have = {r["s"]: r["b"] for r in docs.filter(F.col(source).isin(*weights)).groupBy(F.col(source).alias("s")).agg(size).collect()}
    have = {s: b for s, b in have.items() if b}
    if total is None:
        total = float(sum(have.values()))
    share = sum(weights[s] for s in have)
    return {s: total * weights[s] / share / b for s, b in have.items()} if share else {}


def mixed(docs: DataFrame, weights: dict[str, float] = WEIGHTS, total: float | None = None, seed: int = 42, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every copy of every document, in shuffled order, with ``copy`` (from 0), ``rate`` and ``shuffle_key``.

    Nulls: a null source or one that is not listed has rate 1; a null key draws as the text of null does; a null text
    has no bytes and is drawn like any other. Rows with the same key draw the same count. No row is dropped other than by
    a draw of 0. Columns of ``docs`` that clash with the three new ones give way to them.
    """
    made = ("copy", "rate", "shuffle_key")
    kept = [c for c in docs.columns if c.lower() not in made]
    (count,) = fresh([*docs.columns, *made], "n_copies")
    rates = rates_of(docs, weights, total, source, text)
    rates.setdefault("", 1.0)  # for all others
    tables = poisson_tables(rates)
    pick = lambda values, default: F.coalesce(*[F.when(F.col(source) == s, v) for s, v in values.items() if s or s in weights], default)
    u = uniform(F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    inverse = lambda t: F.aggregate(F.array(*map(F.lit, t[1])), F.lit(t[0]), lambda a, x: a + F.when(x < drawn, 1).otherwise(0))
    (drawn_name,) = fresh([*docs.columns, *made, count], "drawn")
    drawn = F.col(drawn_name)
    out = docs.select(*[F.col(f"`{c}`") for c in kept], u.alias(drawn_name))
    out = out.select(
        *[F.col(f"`{c}`") for c in kept],
        pick({s: F.lit(r) for s, r in rates.items()}, F.lit(rates[""])).alias("rate"),
        pick({s: inverse(t) for s, t in tables.items()}, inverse(tables[""])).alias(count),
    )
    out = out.filter(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(count)
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string"))))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of all documents, mixed to WEIGHTS."""
    out = mixed(table(spark, sf_dir, "documents"))
    return out.withColumn("rate", F.round("rate", 9))


OP6_SQL = """
WITH w AS (SELECT 'src' || i AS source, CASE WHEN i = 0 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE / 19 END AS weight FROM range(20) t(i)),
b AS (SELECT source, sum(octet_length(encode(coalesce(text, ''))))::DOUBLE AS b FROM documents GROUP BY source),
h AS (SELECT w.source, weight, b FROM w JOIN b USING (source) WHERE b > 0),
r AS (SELECT source, (SELECT sum(b) FROM h) * weight / (SELECT sum(weight) FROM h) / b AS rate FROM h),
d AS (SELECT d.*, coalesce(rate, 1.0::DOUBLE) AS rate,
             (('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM documents d LEFT JOIN r ON r.source = d.source),
c AS (SELECT rate, k, exp(-rate) * sum(p) OVER (PARTITION BY rate ORDER BY k) AS f
      FROM (SELECT rate, k, power(rate, k) / factorial(k::INT) AS p FROM (SELECT DISTINCT rate FROM d), range(31) t(k))),
n AS (SELECT doc_id, text, lang, d.source, n_chars, d.rate, (SELECT count(*) FROM c WHERE c.rate = d.rate AND c.f < d.u)::INT AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, k::INT AS copy,
       md5('order 42|' || coalesce(doc_id::VARCHAR, 'null') || '|' || k) AS shuffle_key
FROM n, LATERAL (SELECT unnest(range(n.n)) AS k)
"""
