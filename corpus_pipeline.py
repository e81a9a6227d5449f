"""A training corpus from the table ``documents``: five stages, each of which applies one operator.

``run`` writes what a stage returns to the folder that all executors share and reads it back as the next one's input.

All stages but the last return the columns of their input, in its order, with no others. Columns that a stage does not
read are carried through whatever their names are, those of an operator's own results included. Null texts are empty
ones to the rules, an empty table gives an empty one, and repeated rows are treated alike; what each stage does with null
keys, ties and repeated keys is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm import linededup, mixing, packing, rules, simhash
from copse.llm.common import HAS_WORD, in_batches, table, written

#: Columns that the stages read or change.
READ = ("doc_id", "text", "source", "n_chars")


def _aside(docs: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply`` to ``docs`` with all columns that no stage reads under names that no operator uses."""
    names = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in READ}
    out = apply(docs.toDF(*[names.get(c, c) for c in docs.columns]))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy ``web-1`` rejects go: null, empty and short texts among them. Every row is judged by itself,
    however long its text and whatever its key."""
    return _aside(docs, lambda d: rules.apply_policy(rules.ledger(d)).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later documents (by doc_id) lose the blocks of lines that earlier ones have, and n_chars follows; those that have no
    words left by that go. Rows with a null doc_id and null or empty texts stay as they are; rows that repeat doc_id and
    text are one document."""

    def apply(d: DataFrame) -> DataFrame:
        out = linededup.deduplicated(d).filter((F.col("n_deleted") == 0) | F.col("text").rlike(HAS_WORD))
        return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(d.schema["n_chars"].dataType))

    return _aside(docs, apply)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, that with the smallest doc_id
    stays; links of SimHashes are verified first, and those that they miss are added. Texts without words (null ones too) are equal. Rows that repeat doc_id and text are one; with different texts
    all that are in the smallest doc_id's group stay. Rows with a null doc_id stay."""
    return _aside(docs, lambda d: simhash.deduplicated(d, size=5, similarity=0.8))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by the target weights of their sources, in shuffled order. Null and unlisted sources keep a rate
    of 1; rows that repeat a doc_id, and all with a null one, draw the same number of copies."""
    return _aside(docs, mixing.mixed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies, each with its place in a sequence of at most 2048 tokens. A null or empty text is the end id
    alone; null and repeated doc_ids are kept."""
    with in_batches(spark):
        pieces = written(packing.pieces(docs), "pieces")
    return packing.packed(pieces)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Alignment, similarity and tokens are beyond SQL; each stage is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
