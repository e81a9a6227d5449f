"""Forests over ordinary tables: a hierarchy of keys, conversations, lines of documents, tags of pages.

Labels are made of keys and of running sums within one document's text; at most one order's lines are sorted.
Bytes are positions in the order of nodes where a table has no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copse.functions.places import running
from copse.plans import markup
from copse.plans.forest import Forest


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _element(doc: Column, node_type: str, name: Column, parent: Column, **more: Column) -> list[Column]:
    base = {
        "doc": doc, "node_type": F.lit(node_type), "name": name.cast("string"), "parent": parent.cast("long"), "text": F.lit(""),
        "args": F.array().cast("array<string>"), "mktsegment": F.lit(None).cast("string"), "orderstatus": F.lit(None).cast("string"),
        "orderpriority": F.lit(None).cast("string"), "returnflag": F.lit(None).cast("string"), "linestatus": F.lit(None).cast("string"),
    }
    return [v.alias(k) for k, v in (base | more).items()]


#: Places of an order, and of a customer.
STRIDE, WIDTH = 1 << 20, 1 << 62


def _below(value: Column, most: int, what: str) -> Column:
    """``value`` as a long; an error where it is negative or ``most`` or more."""
    value = value.cast("long")
    return F.when(value.between(0, most - 1), value).otherwise(F.raise_error(F.concat(F.lit(f"{what} has no place: "), F.coalesce(value.cast("string"), F.lit("null")))))


def customers(spark: SparkSession, sf_dir: str, transparent: tuple[str, ...] = ()) -> Forest:
    """customer > order > line, one document for each customer.

    Places are made of keys, with gaps: a customer is [0, 2^62), an order starts at its key, plus one, times 2^20, and its lines
    lie behind it in the order of their numbers. No customer is sorted, whatever it has; the only window is over the lines
    of one order, as some repeat a number. Those with equal numbers are told apart by what their elements say; those alike
    in that are alike. Keys and lines that have no place (2^42 orders, 2^20 lines of one) are an error.
    """
    c, o, l = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    place = (_below(F.col("o_orderkey"), WIDTH // STRIDE - 1, "order") + 1) * STRIDE
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", place.alias("place"))
    l = l.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    l = l.withColumn("j", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_returnflag", "l_linestatus")))
    lines = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    above = (F.col("l_orderkey").cast("long") + 1) * STRIDE
    at = above + _below(F.col("j"), STRIDE, "line")
    nodes = c.select(*_element(F.col("c_custkey"), "customer", F.col("c_name"), F.lit(None), mktsegment=F.col("c_mktsegment"), pre=F.lit(0).cast("long"), last=F.lit(WIDTH - 1)))
    nodes = nodes.unionByName(o.select(*_element(F.col("o_custkey"), "order", F.col("o_orderkey"), F.lit(0), orderstatus=F.col("o_orderstatus"), orderpriority=F.col("o_orderpriority"), pre=F.col("place"), last=F.col("place") + STRIDE - 1)))
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    nodes = nodes.unionByName(lines.select(*_element(F.col("o_custkey"), "line", name, above, returnflag=F.col("l_returnflag"), linestatus=F.col("l_linestatus"), pre=at, last=at)))
    nodes = nodes.withColumn("start_byte", F.col("pre")).withColumn("end_byte", F.col("last") + 1)
    return Forest(nodes, transparent=transparent, columns=("mktsegment", "orderstatus", "orderpriority", "returnflag", "linestatus"))


def regions(spark: SparkSession, sf_dir: str) -> Forest:
    """region > nation > customer and supplier, one document for each nation within its region (the region is repeated as the
    root of each, so that a region with all customers is split by nation)."""
    r, n, c, s = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    rn = F.broadcast(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows in the schema
    doc = F.col("n_nationkey").cast("long")
    lit = lambda x: F.lit(x).cast("long")
    nodes = rn.select(*_element(doc, "region", F.col("r_name"), F.lit(None), pre=lit(0), last=lit((1 << 60) - 1)))
    nodes = nodes.unionByName(rn.select(*_element(doc, "nation", F.col("n_name"), F.lit(0), pre=lit(1), last=lit((1 << 60) - 1))))
    for t, key, name, nation, k, segment in ((c, "c_custkey", "c_name", "c_nationkey", 0, F.col("c_mktsegment")), (s, "s_suppkey", "s_name", "s_nationkey", 1, F.lit(None).cast("string"))):
        pre = F.col(key).cast("long") * 2 + 2 + k
        nodes = nodes.unionByName(t.select(*_element(F.col(nation).cast("long"), ("customer", "supplier")[k], F.col(name), F.lit(1), mktsegment=segment, pre=pre, last=pre)))
    nodes = nodes.withColumn("start_byte", F.col("pre")).withColumn("end_byte", F.col("last") + 1)
    return Forest(nodes, transparent=(), columns=("mktsegment",))


def parts(spark: SparkSession, sf_dir: str) -> Forest:
    """Parts as roots; their name's words are arguments, the brand is the declared type."""
    p = read(spark, sf_dir, "part")
    zero = F.lit(0).cast("long")
    nodes = p.select(
        F.col("p_partkey").alias("doc"), F.lit("part").alias("node_type"), F.col("p_name").alias("name"), F.lit(None).cast("long").alias("parent"), zero.alias("pre"), zero.alias("last"),
        zero.alias("start_byte"), (zero + 1).alias("end_byte"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), F.split("p_name", " ").alias("args"), F.col("p_brand").alias("decl_type"),
    )
    return Forest(nodes, typed=True)


def conversations(spark: SparkSession, sf_dir: str) -> Forest:
    """conversation > turns (their role is the kind), byte positions are turn numbers."""
    t = read(spark, sf_dir, "conversations")
    long = lambda c: c.cast("long")
    roots = t.groupBy("conv_id").agg(F.max("turn").alias("m")).select(
        F.col("conv_id").alias("doc"), F.lit("conversation").alias("node_type"), F.col("conv_id").cast("string").alias("name"), F.lit(None).cast("long").alias("parent"), long(F.lit(0)).alias("pre"),
        long(F.col("m") + 1).alias("last"), long(F.lit(0)).alias("start_byte"), long(2 * F.col("m") + 3).alias("end_byte"), F.lit("").alias("text"))
    turns = t.select(
        F.col("conv_id").alias("doc"), F.col("role").alias("node_type"), F.col("turn").cast("string").alias("name"), long(F.lit(0)).alias("parent"), long(F.col("turn") + 1).alias("pre"),
        long(F.col("turn") + 1).alias("last"), long(2 * F.col("turn") + 1).alias("start_byte"), long(2 * F.col("turn") + 2).alias("end_byte"), "text")
    return Forest(roots.unionByName(turns).withColumn("args", F.array().cast("array<string>")))


def lines(spark: SparkSession, sf_dir: str) -> Forest:
    """document > lines, with byte spans; a line's name is its text. Spans are running sums over the array of one document's
    lines, so no shuffle is needed."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("whole"))
    each = F.split(F.coalesce("whole", F.lit("")), "\n")
    spans = d.withColumn("l", each).withColumn("ends", running(F.transform("l", lambda x: F.octet_length(x).cast("long") + 1)))
    line = lambda x, i: F.struct((i + 1).cast("long").alias("pre"), x.alias("text"), (F.get("ends", i) - F.octet_length(x) - 1).alias("start_byte"), (F.get("ends", i) - 1).alias("end_byte"))
    body = spans.select("doc", F.explode(F.transform("l", line)).alias("x")).select("doc", "x.*")
    body = body.select("doc", F.lit("line").alias("node_type"), F.col("text").alias("name"), F.lit(0).cast("long").alias("parent"), "pre", F.col("pre").alias("last"), "start_byte", "end_byte", "text")
    roots = spans.select("doc", F.lit("document").alias("node_type"), F.col("doc").cast("string").alias("name"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("pre"), F.size("l").cast("long").alias("last"),
                         F.lit(0).cast("long").alias("start_byte"), F.octet_length(F.coalesce("whole", F.lit(""))).cast("long").alias("end_byte"), F.coalesce("whole", F.lit("")).alias("text"))
    return Forest(roots.unionByName(body).withColumn("args", F.array().cast("array<string>")))


def pages(spark: SparkSession, sf_dir: str) -> Forest:
    """Pages as roots named by their url."""
    zero = F.lit(0).cast("long")
    nodes = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc"), F.lit("page").alias("node_type"), F.coalesce("url", F.lit("")).alias("name"), F.lit(None).cast("long").alias("parent"), zero.alias("pre"), zero.alias("last"),
        zero.alias("start_byte"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("end_byte"), F.coalesce("html", F.lit("")).alias("text"), F.array().cast("array<string>").alias("args"))
    return Forest(nodes)


def tags(spark: SparkSession, sf_dir: str) -> Forest:
    """Tags of pages, with their places in the text; those that open or close nothing are ERROR."""
    return markup.forest(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text")))
