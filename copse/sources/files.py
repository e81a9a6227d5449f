"""Source files as documents: folders walked by Spark's reader, languages, parsed elements, selections over all languages.

Documents: doc (the path), path (relative to the scope), language, source, size, mod_time (Unix seconds), sha256, and error
where they come from files.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from copse.functions import patterns, scalars
from copse.plans.forest import CONTAINERS, Forest
from copse.providers import catalog, registry
from copse.providers.tree import ROOT
from copse.selector import Query
from copse.sources import shared, walking

#: Rows of elements that are handed to Spark at once.
CHUNK = 20_000
ELEMENTS = """doc string, language string, has_error boolean, pre long, last long, parent long, depth int, ord int, node_type string, field string, start_byte long, end_byte long, start_row int, start_col int,
end_row int, end_col int, name string, text string, args array<string>, decl_type string, exported boolean, cand_pre long, is_target boolean, is_node boolean, only array<string>, member string"""
DOCUMENTS = "doc string, path string, language string, source string, size long, mod_time long, sha256 string"


parser = registry.parser


class ScopeError(ValueError):
    """A scope that cannot be walked."""


@dataclass(frozen=True)
class Scope:
    """A folder and what of it is meant. 0 is no limit; the root's own files have depth 0."""

    path: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_depth: int = 0
    max_files: int = 0
    follow_symlinks: bool = False
    language: str = ""

    def local(self) -> str | None:
        """The folder if it is on this machine's file system."""
        bare = self.path.removeprefix("file://")
        return None if "://" in bare else os.path.abspath(bare)

    def checked(self) -> Scope:
        if not self.path.strip():
            raise ScopeError("a scope needs a path")
        here = self.local()
        if here is not None and not os.path.exists(here):
            raise ScopeError(f"{self.path} does not exist")
        if here is not None and not os.path.isdir(here):
            raise ScopeError(f"{self.path} is no folder")
        return self


def listing(spark: SparkSession, scope: Scope) -> DataFrame:
    """doc, path, language, size, mod_time and stamp (of the last change, as fine as it is known) of a scope's files; none is
    read. With ``max_files`` the first files in the order of folders' sorted entries stay.

    Folders of a local scope, which executors have to share, are listed by tasks, and those that are excluded or too deep are
    not opened (``walking``). A store's are listed by Spark's reader.
    """
    scope = scope.checked()
    here = scope.local()
    if here is not None:
        found = walking.entries(spark, here, scope.exclude, scope.max_depth, scope.follow_symlinks).filter("kind = 'file'")
        found = found.select(F.concat(F.lit(here.rstrip("/") + "/"), "path").alias("doc"), "path", "size", "mod_time", "stamp")
    else:
        root = scope.path.rstrip("/")
        found = _store(spark, scope).select(F.col("path").alias("doc"), F.col("path").substr(F.lit(len(root) + 2), F.length("path")).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mod_time"), F.unix_micros("modificationTime").alias("stamp"))
    found = found.filter(patterns.in_scope(F.col("path"), scope.include, scope.exclude))
    if scope.max_depth:
        found = found.filter(scalars.depth(F.col("path")) <= scope.max_depth)
    return first_files(found.withColumn("language", scalars.language(F.col("path"), scope.language)), scope.max_files)


def _store(spark: SparkSession, scope: Scope) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(scope.path)


def first_files(found: DataFrame, n: int, *ties: str) -> DataFrame:
    """The first ``n`` files (0: all) in the order of folders' sorted entries, then of ``ties``."""
    return found.orderBy(F.split("path", "/"), *ties).limit(n) if n else found


def walk(spark: SparkSession, scope: Scope) -> DataFrame:
    """Documents of a scope, with ``error``. Bytes that are no UTF-8 are replaced; a file that cannot be read has a null source
    and says why, and no other file is the worse for it (a store's reader fails instead)."""
    found, here = listing(spark, scope), scope.local()
    if here is not None:
        read = walking.read(found, here, ["doc", "path", "language", "size", "mod_time"])
    else:
        contents = _store(spark, scope).select(F.col("path").alias("doc"), "content")
        read = found.join(contents, "doc").withColumn("error", F.lit(None).cast("string"))
    return read.select("doc", "path", "language", scalars.utf8(F.col("content")).alias("source"), "size", "mod_time", F.sha2("content", 256).alias("sha256"), "error")


def paths(spark: SparkSession, scope: Scope) -> DataFrame:
    return listing(spark, scope).select("path")


def language_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("language").agg(F.count("*").alias("n"))


def inline(spark: SparkSession, language: str, **sources: str) -> DataFrame:
    """Documents from texts."""
    import hashlib

    rows = [(k, k, language, v, len(v.encode()), 0, hashlib.sha256(v.encode()).hexdigest()) for k, v in sources.items()]
    return spark.createDataFrame(rows, DOCUMENTS)


#: Types of nodes by language that have rows (``ROOT``: the root, of whatever type); a language that is not there has rows of all.
Types = dict[str, frozenset[str]]


def parsed(docs: DataFrame, types: Types | None = None) -> DataFrame:
    """Elements of all documents whose language has a parser. A narrow step: each document is parsed where it is, and its
    rows leave in chunks. Null sources are empty. ``types``: nodes that have rows (``read_types``); whether there is an error
    is told of the whole document all the same."""
    parsers = {x: registry.parser(x) for x in registry.languages()}  # those of this moment go to the executors
    types = types or {}
    schema = to_arrow_schema(T._parse_datatype_string(ELEMENTS))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.providers.tree import numbered, rows

        def frame(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

        held: list[tuple] = []
        for f in frames:
            for doc, language, source in zip(*(f.column(x).to_pylist() for x in ("doc", "language", "source"))):
                parse, module = parsers[language]
                text = source or ""
                root = parse(text)
                nodes = numbered(root)
                bad = any(n.type == "ERROR" for n in nodes)
                held += [(doc, language, bad, *r) for r in rows(root, text, module, types.get(language), nodes)]
                for n in nodes:
                    n.up = None  # without circles a tree goes at once
                while len(held) >= CHUNK:
                    yield frame(held[:CHUNK])
                    held = held[CHUNK:]
        if held:
            yield frame(held)

    docs = docs.filter("error is null") if "error" in docs.columns else docs
    known = docs.filter(F.col("language").isin(*parsers)).select(F.col("doc").cast("string"), "language", "source")
    return known.mapInArrow(batches, ELEMENTS)


def parsed_once(docs: DataFrame, types: Types | None = None) -> DataFrame:
    """``parsed``, written to the folder that all executors share: for selectors that read the elements more than once."""
    return shared.written(parsed(docs, types), "elements")


def _kinds(language: str) -> tuple[dict[str, tuple[str, ...]], dict[str, str]]:
    """Kinds and canonical spellings of a language."""
    added = registry.added(language)
    return (dict(added.kinds), dict(added.canonical)) if added else (catalog.kinds(language), catalog.CANONICAL[language])


def read_types(query: Query, languages: tuple[str, ...], *more: str) -> Types:
    """The types of nodes that a selection reads, by language, and ``more``: those of its kinds and, where it asks for direct
    children, the containers that these may lie in. A selector with siblings reads the parents of its matches, whatever
    they are, and so all."""

    def of(q: Query, kinds: dict, canonical: dict) -> frozenset[str] | None:
        if {"before", "after"} & set(q.attributes):
            return None
        kind = canonical.get(q.kind, q.kind)
        parts = [of(x, kinds, canonical) for x in (*q.operands, *([q.contains] if q.contains else []))]
        return None if None in parts else frozenset(kinds.get(kind, (kind,)) if kind else ()).union(*parts, CONTAINERS if q.direct else ())

    found = {x: of(query, *_kinds(x)) for x in languages}
    return {x: types.union(more) for x, types in found.items() if types is not None}


#: What a call of ``stored`` finds: documents, and texts (one for each language and digest) that it has and that it parses.
USE = "at long, documents long, hits long, misses long"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(docs: DataFrame, table: str, seconds: int = 0, now: int | None = None) -> DataFrame:
    """Elements by way of a table that keeps them by (language, sha256): texts that it has are not parsed again, equal
    texts are parsed once. ``table`` is a folder that executors share.

    Elements are written to a folder of the second they are written at. With ``seconds`` they are too old after that time:
    their folders are not read any more, and their texts parsed anew. ``now``: seconds, the clock if not given. What each
    call finds is counted in ``use``.
    """
    spark, now = docs.sparkSession, int(time.time()) if now is None else now
    key = F.concat_ws(":", "language", "sha256")
    keyed = docs.filter(F.col("language").isin(*registry.languages())).withColumn("key", key)
    keyed = keyed.filter("error is null") if "error" in docs.columns else keyed
    wanted = keyed.groupBy(F.col("key").alias("doc")).agg(F.min(F.struct("language", "source")).alias("t"), F.count("*").alias("n")).select("doc", "t.*", "n")
    have = _fresh(spark, table, seconds, now)
    found = wanted.join(have.filter("pre = 0").select(F.col("doc").alias("has")).distinct(), F.col("doc") == F.col("has"), "left")
    found = shared.written(found.select("doc", "language", F.when(F.col("has").isNull(), F.col("source")).alias("source"), "n", F.col("has").isNotNull().alias("hit")), "wanted_texts")
    parsed(found.filter("not hit")).write.mode("append").parquet(f"{table}/elements/written={now}")
    counts = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    counts.select(F.lit(now).cast("long").alias("at"), "documents", "hits", "misses").write.mode("append").parquet(f"{table}/use")
    # a text that was parsed twice, as it was too old in between, has the rows of the last time
    latest = _fresh(spark, table, seconds, now).filter("pre = 0").groupBy(F.col("doc").alias("of")).agg(F.max("written").alias("newest"))
    kept = _fresh(spark, table, seconds, now).join(latest, (F.col("doc") == F.col("of")) & (F.col("written") == F.col("newest"))).withColumnRenamed("doc", "key").drop("language", "written", "of", "newest")
    return keyed.select("key", "doc", "language").join(kept, "key").drop("key")


def _fresh(spark: SparkSession, table: str, seconds: int, now: int) -> DataFrame:
    """Elements that are not too old, with ``written``; only their folders are read."""
    schema = T._parse_datatype_string(ELEMENTS).add("written", T.LongType())
    where, fs = _folder(spark, f"{table}/elements")
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{table}/elements")
    return rows.filter(F.col("written") > now - seconds) if seconds else rows


def use(spark: SparkSession, table: str) -> DataFrame:
    """What each call of ``stored`` has found (``USE``), with the share of texts that were there."""
    where, fs = _folder(spark, f"{table}/use")
    rows = spark.read.schema(USE).parquet(f"{table}/use") if fs.exists(where) else spark.createDataFrame([], USE)
    texts = F.col("hits") + F.col("misses")
    return rows.withColumn("hit_rate", F.when(texts > 0, F.col("hits") / texts))


def expire(spark: SparkSession, table: str, seconds: int, now: int | None = None) -> int:
    """Delete folders of elements that are too old; returns how many. Nothing is rewritten."""
    now = int(time.time()) if now is None else now
    where, fs = _folder(spark, f"{table}/elements")
    old = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith("written=") and int(x.getPath().getName()[8:]) <= now - seconds] if fs.exists(where) else []
    for path in old:
        fs.delete(path, True)
    return len(old)


def forest(elements: DataFrame, language: str, broken: bool = False) -> Forest:
    """The forest of one language. Documents with syntax errors are left out unless ``broken``."""
    is_ = lambda what: F.col("member") == what
    of = elements.filter(F.col("language") == language)
    of = of if broken else of.filter("not has_error")
    if added := registry.added(language):
        return Forest(of, *_kinds(language), checks={k: v() for k, v in added.checks.items()}, typed=added.declared_type is not registry._nothing)
    checks: dict[str, Column] = {
        "go": {"struct": is_("struct"), "interface": is_("interface"), "iface": is_("interface")},
        "python": {},
        "javascript": {"constructor": is_("constructor"), "ctor": is_("constructor")},
        "typescript": {"constructor": is_("constructor"), "ctor": is_("constructor"), "getter": is_("getter"), "setter": is_("setter"), "accessor": is_("accessor")},
        "php": {"constructor": is_("constructor"), "ctor": is_("constructor")},
    }[language]
    return Forest(of, *_kinds(language), checks=checks, typed=language == "go")


def reads(query: Query) -> int:
    """How often a selection reads its elements."""
    own = 1 + (2 if query.direct else 0) + sum(name in ("before", "after") for name in query.attributes)
    return (query.op == "not") + max(1, sum(map(reads, query.operands))) if query.op else own + (reads(query.contains) if query.contains else 0)


def select(source: DataFrame, query: Query, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Matches in documents (or their elements) of all languages, each with its own kinds. Documents are parsed once: their
    elements are written where several languages, or several parts of the selector, read them."""
    languages = registry.languages() if languages is None else languages
    if "node_type" not in source.columns:
        source, types = source.filter(F.col("language").isin(*languages)), read_types(query, languages)
        source = parsed_once(source, types) if len(languages) * reads(query) > 1 else parsed(source, types)
    return reduce(DataFrame.unionByName, [forest(source, x).select(query) for x in languages])


def rejects(elements: DataFrame) -> DataFrame:
    """Documents that a selection leaves out, with their errors."""
    return Forest(elements).errors()


def has_errors(text: Column, language: str) -> Column:
    """Whether a text has syntax errors: what a rewritten one is checked for."""
    known = registry.parser(language)

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        from copse.providers.tree import numbered

        parse, _ = known
        return pd.Series([any(n.type == "ERROR" for n in numbered(parse(t or ""))) for t in texts], dtype="boolean")

    return check.asNondeterministic()(text)  # so that filters on what depends on it do not parse once more


def transform(source: DataFrame, method: str, query: Query, payload: str = "", languages: tuple[str, ...] | None = None) -> DataFrame:
    """Documents (or their elements) rewritten: ``operators.rewrite.transform`` with each language's exported names and its check of the result.
    Documents with errors are rewritten, too. ``append`` places the text as ``operators.append`` says."""
    from copse.operators import append, rewrite

    languages, parts = registry.languages() if languages is None else languages, []
    if "node_type" not in source.columns:
        source = parsed_once(source.filter(F.col("language").isin(*languages)), read_types(query, languages, ROOT))
    for language in languages:
        f = forest(source, language, broken=True)
        place = append.placing(language, payload) if language in append.SMART else None
        if method == "append" and not (query.kind or query.name):
            parts.append(rewrite.append_to_root(f, payload, place))
        else:
            parts.append(rewrite.transform(f, method, query, payload, F.col("exported"), has_errors(F.decode("result", "UTF-8"), language), place))
    return reduce(DataFrame.unionByName, parts)
