"""Sharding by extendible hashing: a directory indexed by hash-prefix bits.

All rows begin in one bucket of depth 0. A bucket whose bytes exceed the limit splits on the next bit of its rows' hash;
others stay as they are, so that the directory is deep only where it has to be. The hash is the MD5 of the key, followed
by the MD5 of the row's text where equal keys fill more than a shard: 256 bits. Bytes are first summed by a prefix long
enough for about four cells a shard, with partial sums, and only cells that are still too large go on with their rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import fresh, table, written

#: Bytes of text of a shard, at most.
LIMIT = 64 << 20
BITS = 256
#: Bits that one pass looks at.
STRIDE = 8


def hash_bits(key: Column, text: Column) -> Column:
    """256 bits as a string of 0 and 1: the MD5 of key (null is its own), then of text."""
    digits = F.concat(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), F.md5(F.coalesce(text, F.lit(""))))
    part = lambda i: F.lpad(F.conv(F.substring(digits, 8 * i + 1, 8), 16, 2), 32, "0")
    return F.concat(*[part(i) for i in range(BITS // 32)])


def directory(sizes: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """shard (its prefix bits, '' for the whole), depth, bytes and rows of every bucket, from ``sizes``: bits and bytes; and
    the depth that the first pass looked at.

    Each pass sums the bytes of all prefixes that are the next ``STRIDE`` bits longer than a bucket that is too large, and
    takes the shortest that fit: passes go by depth, about log2(bytes / limit) / STRIDE, and not by shards. A bucket
    that is still too large after all bits holds rows equal in key and text, or one row, and is kept with overflow true.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    first = min(BITS, max(STRIDE, math.ceil(math.log2(total / limit + 1)) + 2))
    out = spark.createDataFrame([], "shard string, depth int, bytes long, n long, overflow boolean")
    depth, open_ = 0, sizes.select(F.lit("").alias("prefix"), "bits", "bytes")
    step = first
    while True:
        end = min(BITS, depth + step)
        cells = open_.groupBy("prefix", F.substring("bits", 1, end).alias("cell")).agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("n"))
        cells = written(cells, f"cells_{end}")
        # every prefix of a cell from the bucket's own depth on, with its bytes: the shortest that fits is a shard
        each = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(depth), F.lit(end))).alias("depth")).withColumn("shard", F.expr("left(cell, depth)"))
        by = written(each.groupBy("shard", "depth").agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("n").cast("long").alias("n")), f"prefixes_{end}")
        fit = by.filter((F.col("bytes") <= limit))
        parents = by.filter(F.col("bytes") > limit).select(F.col("shard").alias("parent"))
        tops = fit.filter("depth > 0").join(parents, F.expr("left(shard, depth - 1)") == F.col("parent"), "left_semi")
        if not depth:
            tops = tops.unionByName(fit.filter("depth = 0"))
        out = out.unionByName(tops.select("shard", "depth", "bytes", "n", F.lit(False).alias("overflow")))
        over = by.filter((F.col("bytes") > limit) & (F.col("depth") == end))
        if over.isEmpty():
            break
        if end == BITS:
            out = out.unionByName(over.select("shard", "depth", "bytes", "n", F.lit(True).alias("overflow")))
            break
        # one row that is larger than a shard stops here, too: more bits would not make it smaller
        single = over.filter("n = 1")
        out = out.unionByName(single.select("shard", "depth", "bytes", "n", F.lit(True).alias("overflow")))
        left = written(over.filter("n > 1").select(F.col("shard").alias("prefix")), f"open_{end}")
        if left.isEmpty():
            break
        open_ = written(sizes.select(F.substring("bits", 1, end).alias("prefix"), "bits", "bytes").join(left, "prefix", "left_semi"), f"rows_{end}")
        depth, step = end, STRIDE
    return written(out, "directory"), first


def sharded(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add shard (prefix bits), depth and overflow to every row of ``docs``; no row is left out.

    Bytes are those of the text in UTF-8, 0 for null. Rows equal in key and text share all bits and so a shard; if they
    exceed the limit together, or one row does alone, their shard has overflow true. Columns that clash give way.
    """
    made = ("shard", "depth", "overflow")
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    bits, size = fresh([*kept, *made], "bits", "bytes")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], hash_bits(F.col(key), F.col(text)).alias(bits), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias(size))
    sizes = written(rows.select(F.col(bits).alias("bits"), F.col(size).alias("bytes")), "sizes")
    out = _located(rows, *directory(sizes, limit), bits)
    return out.select(*[F.col(f"`{c}`") for c in kept], *made)


def _located(rows: DataFrame, shards: DataFrame, first: int, bits: str) -> DataFrame:
    """Look rows up in the directory by one prefix, that of the first pass: a shard that is not as deep is entered with all
    prefixes of that length which it has (a few for each shard, as the first pass goes by bytes over limit). Where shards
    are deeper, the prefix says so, and only its rows are looked up again, by the next pass's prefix."""
    deepest = shards.agg(F.max("depth")).first()[0]
    if deepest is None:  # no rows
        return rows.withColumns({"shard": F.lit(""), "depth": F.lit(0), "overflow": F.lit(False)})
    out, above, end = None, -1, first
    (cell,) = fresh(rows.columns, "cell")
    while True:
        own = shards.filter((F.col("depth") > above) & (F.col("depth") <= end))
        spare = lambda n: F.when(n > 0, F.lpad(F.conv(F.col("k").cast("string"), 10, 2), n, "0")).otherwise("")
        k = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {end} - depth)") - 1))
        cells = own.withColumn("k", k).select(F.concat("shard", spare(F.lit(end) - F.col("depth"))).alias(cell), "shard", "depth", "overflow")
        deeper = shards.filter(F.col("depth") > end).select(F.expr(f"left(shard, {end})").alias(cell)).distinct()
        cells = cells.unionByName(deeper.select(cell, F.lit(None).cast("string").alias("shard"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("boolean").alias("overflow")))
        met = rows.withColumn(cell, F.substring(bits, 1, end)).join(written(cells, f"entries_{end}"), cell)
        found = met.filter("shard is not null").drop(cell)
        out = found if out is None else out.unionByName(found)
        if deepest <= end:
            return out
        rows, above, end = met.filter("shard is null").drop(cell, "shard", "depth", "overflow"), end, min(BITS, end + STRIDE)


def write(docs: DataFrame, path: str, limit: int = LIMIT, **options) -> DataFrame:
    """Write each shard as a folder ``shard=<bits>`` and give the frame that was written."""
    out = sharded(docs, limit, **options).withColumn("shard", F.concat(F.lit("b"), "shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)
    return out


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, with its bytes."""
    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.octet_length("text").cast("long"))
    return sharded(docs, carry=["doc_id", "n_bytes"])


#: A limit that splits small tables, too.
SMALL = 1 << 18


def shards_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of at most 256 KiB, so that buckets split at every size of the table."""
    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.octet_length("text").cast("long"))
    return sharded(docs, SMALL, carry=["doc_id", "n_bytes"])


def op5_sql(limit: int = LIMIT) -> str:
    return f"""
WITH d AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(coalesce(doc_id::VARCHAR, 'null')) || md5(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, n_bytes, array_to_string(list_transform(string_split(h, ''), lambda c: right((('0x' || c)::INT)::BIT::VARCHAR, 4)), '') AS bits FROM d),
p AS (SELECT doc_id, n_bytes, depth, left(bits, depth) AS prefix FROM b, (SELECT unnest(range(0, 33))::INT AS depth)),
s AS (SELECT *, sum(coalesce(n_bytes, 0)) OVER (PARTITION BY depth, prefix) AS total, count(*) OVER (PARTITION BY depth, prefix) AS n FROM p),
f AS (SELECT doc_id, n_bytes, min_by(prefix, depth) AS shard, min(depth) AS depth FROM s WHERE total <= {limit} GROUP BY doc_id, n_bytes)
SELECT doc_id, n_bytes, shard, depth, false AS overflow FROM f
"""


OP5_SQL = op5_sql()
SPLIT_SQL = op5_sql(SMALL)
