"""Tags of markup as a forest, and what is wrong with them, without a parser.

A text is cut into tokens by one regular expression that covers all of it, so that running sums of their sizes are their
places. Opening and closing tags are paired by name: the depth of a name is a running sum over its tags, and a tag that
closes takes the last one of the same depth. What is left over is an ERROR. Windows are over the tags of one text, which is
one row to begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from copse.functions import places
from copse.plans.forest import Forest

#: Elements that have no end (fixed values of the markup's standard).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose content is no markup.
RAW = ("script", "style")
#: All of a text: comments, elements with raw content, tags, text, and a < that begins nothing.
TOKEN = "|".join(["<!--.*?-->", *(rf"<{x}\b[^>]*>.*?</{x}\s*>" for x in RAW), "<[^<>]*>", "[^<]+", "<"])
NAME = r"^</?([A-Za-z][A-Za-z0-9:-]*)"


def tags(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, k (its number among the tags), name, form (open, close, void or whole), token, start_byte, end_byte, and rows and columns of both, of the
    tags of each row of ``docs`` (doc, ``text``). Null texts have none."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s)({TOKEN})"), F.lit(1))
    cut = docs.select("doc", tokens.alias("tokens"), places.line_starts(F.col(text)).alias("starts"))

    def tag(x: Column, end: Column, starts: Column) -> Column:
        start = end - F.octet_length(x)
        return F.struct(x.alias("token"), start.alias("start_byte"), end.alias("end_byte"), places.place(starts, start).alias("from"), places.place(starts, end).alias("to"))

    ends = places.running(F.transform("tokens", lambda x: F.octet_length(x).cast("long")))
    zipped = F.zip_with("tokens", ends, lambda x, end: F.struct(x.alias("token"), end.alias("end")))
    named = F.filter(zipped, lambda x: x["token"].rlike(NAME))
    made = places.let(F.col("starts"), lambda starts: F.transform(named, lambda x: tag(x["token"], x["end"], starts)))
    each = cut.filter("size(tokens) > 0").select("doc", F.posexplode(made).alias("k", "t")).select("doc", "k", "t.*")
    name = F.lower(F.regexp_extract("token", NAME, 1))
    form = F.when(F.col("token").startswith("</"), "close").when(name.isin(*VOID) | F.col("token").endswith("/>"), "void").when(name.isin(*RAW), "whole").otherwise("open")
    return each.select("doc", "k", name.alias("name"), form.alias("form"), "token", "start_byte", "end_byte", F.col("from.row").alias("start_row"), F.col("from.col").alias("start_col"), F.col("to.row").alias("end_row"), F.col("to.col").alias("end_col"))


def paired(found: DataFrame) -> DataFrame:
    """``tags`` with ``partner`` (k of the tag that closes an open one, or of the one that is closed) and wrong (an open tag
    that nothing closes, or a closing one that closes nothing)."""
    of = W.partitionBy("doc", "name").orderBy("k")
    along = of.rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("form") == "open", 1).when(F.col("form") == "close", -1).otherwise(0)
    d = found.withColumn("depth", F.sum(step).over(along))
    least = F.least(F.lit(0), F.min("depth").over(along))  # tags that close nothing do not count
    d = d.withColumn("least", least).withColumn("before", F.coalesce(F.lag("least").over(of), F.lit(0)))
    stray = (F.col("form") == "close") & (F.col("least") < F.col("before"))
    level = F.when(F.col("form") == "open", F.col("depth") - F.col("least")).when((F.col("form") == "close") & ~stray, F.col("depth") - F.col("least") + 1)
    d = d.withColumn("level", level)
    same = W.partitionBy("doc", "name", "level").orderBy("k")
    partner = F.when(F.col("level").isNull(), None).when(F.col("form") == "open", F.lead("k").over(same)).otherwise(F.lag("k").over(same))
    return d.withColumn("partner", partner).withColumn("wrong", F.col("form").isin("open", "close") & F.col("partner").isNull()).drop("depth", "least", "before", "level")


def forest(docs: DataFrame, text: str = "text") -> Forest:
    """doc > tags: of kind tag, named by their element, from the opening to the closing tag; those that are wrong are ERROR.

    Pairs of different names may overlap; a tag is placed by where it opens, and its parent is not known, so that direct
    children and siblings are not asked for here.
    """
    found = paired(tags(docs, text))
    close = found.filter("form = 'close' and not wrong").select(F.col("doc").alias("d"), F.col("k").alias("ck"), F.col("end_byte").alias("e"), F.col("end_row").alias("r"), F.col("end_col").alias("c"))
    opened = found.filter("form <> 'close' or wrong").join(close, (F.col("doc") == F.col("d")) & (F.col("partner") == F.col("ck")), "left")
    long = lambda c: F.col(c).cast("long")
    node = F.when(F.col("wrong"), "ERROR").otherwise("tag")
    return Forest(opened.select(
        "doc", long("k").alias("pre"), F.coalesce(long("partner"), long("k")).alias("last"), F.lit(None).cast("long").alias("parent"), node.alias("node_type"), "name", F.col("token").alias("text"),
        "start_byte", F.coalesce("e", "end_byte").alias("end_byte"), "start_row", "start_col", F.coalesce("r", "end_row").alias("end_row"), F.coalesce("c", "end_col").alias("end_col"), F.array().cast("array<string>").alias("args")), transparent=())
