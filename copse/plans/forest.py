"""Ordered forests as DataFrames, and selectors compiled to plans over them.

Elements: doc, pre, last, parent, depth, node_type, named, field, start_byte, end_byte, start_row, start_col, end_row,
end_col, name, text and args. ``pre`` numbers a document's nodes in document order from 0, ``last`` is the largest number in a
node's subtree, ``parent`` is the parent's number (null for roots). So a node lies below another if its number is between.

Targets (what a kind selects) add kind, cand_pre (the declaration that was matched) and node_pre (the node that is bound:
one declaration may bind several names). A selector compiles to filters, semi-joins, anti-joins and unions on targets;
nothing is collected, and equal sub-selectors of a query are compiled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from copse.functions import patterns, places
from copse.selector import Query
from copse.sources.shared import written

#: Nodes that stand for their children when direct children are asked for.
CONTAINERS = ("block", "body", "class_body", "declaration_list", "statement_block", "compound_statement")
#: What tells two matches apart.
IDENTITY = ("doc", "kind", "start_byte", "end_byte", "name")


#: Positions of a document that one task goes through: so many bits of ``pre``.
SPAN = 20


def _reaching(out: DataFrame, at: Column, bound: Column, points: DataFrame, agg, later: bool, holds) -> DataFrame:
    """Rows of ``out`` for which ``holds(nearest, bound)`` is true, where nearest is the least (agg min) or greatest (agg max)
    ``value`` of the document's ``points`` (doc, at, value) whose place is after ``at`` (later) or up to it.

    Only places and bounds are sorted, once, with the points, and passed through with a running aggregate; ``out`` is met
    by what is left of them. A document is split into spans of places, so that a large one is many tasks'; what other
    spans hold is a running aggregate over one row for each span. Rows and points are read twice, so points that
    are more than a filter on elements should be a written table: then exchanges grow by a constant for each level.
    """
    span = F.shiftright("at", SPAN).alias("span")
    places = out.select("doc", at.cast("long").alias("at"), bound.cast("long").alias("bound"))
    rows = places.select("doc", span, "at", "bound", F.lit(None).cast("long").alias("value"))
    marks = points.select("doc", span, "at", F.lit(None).cast("long").alias("bound"), F.col("value").cast("long").alias("value"))
    order = (F.desc("at"), F.col("bound").isNull()) if later else (F.col("at"), F.col("bound").isNotNull())  # a point at the place itself is not later
    along = lambda *by, to: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, to)
    passed = rows.unionByName(marks).withColumn("own", agg("value").over(along("doc", "span", to=W.currentRow).orderBy(*order))).filter("bound is not null")
    spans = rows.unionByName(marks).groupBy("doc", "span").agg(agg("value").alias("all"))
    spans = spans.select("doc", "span", agg("all").over(along("doc", to=-1).orderBy(F.desc("span") if later else "span")).alias("others"))
    best = F.least if agg is F.min else F.greatest
    found = passed.join(spans, ["doc", "span"]).filter(holds(best("own", "others"), F.col("bound")))
    found = found.select(F.col("doc").alias("of"), F.col("at").alias("of_at"), F.col("bound").alias("of_bound"))
    return out.join(found, (F.col("doc") == F.col("of")) & (at == F.col("of_at")) & (bound == F.col("of_bound")), "left_semi")


def _stacks(schema: T.StructType):
    """A function on sorted rows (doc, span, at, last, info) that gives each row without ``last`` the open intervals."""
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, stack = None, []
        for batch in batches:
            which, scopes = [], []
            columns = [batch.column(c).to_pylist() for c in ("doc", "span", "at", "last", "info")]
            for i, (doc, span, at, last, info) in enumerate(zip(*columns)):
                if (doc, span) != where:
                    where, stack = (doc, span), []
                while stack and stack[-1][0] < at:
                    stack.pop()
                if last is None:
                    which.append(i)
                    scopes.append([x for _, x in stack])
                else:
                    stack.append((last, info))
            rows = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(rows), batch.column("at").take(rows), pa.array(scopes, types.field("scope").type)], schema=types)

    return run


@dataclass
class Forest:
    """elements, and the kinds that select them.

    kinds: kind to node types; a kind that is not listed is a node type itself. canonical: other spellings of kinds.
    transparent: node types that ``>>`` looks through, one level. checks: kind to a condition on elements besides the type.
    Elements may have ``only`` (the kinds that see the row, null: all), ``is_target`` and ``is_node`` (false: a bound node).
    typed: ``type=`` is known (the elements have decl_type), else it is ignored like any unknown attribute.
    columns: attributes that are columns of the elements, compared as text with name patterns.
    Where a declaration binds nodes, each is a row of its own, whose ``cand_pre`` is the declaration's number.
    """

    elements: DataFrame
    kinds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    canonical: dict[str, str] = field(default_factory=dict)
    transparent: tuple[str, ...] = CONTAINERS
    checks: dict[str, Column] = field(default_factory=dict)
    typed: bool = False
    columns: tuple[str, ...] = ()
    _seen: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def canonical_query(self, q: Query) -> Query:
        from dataclasses import replace

        return replace(q, kind=self.canonical.get(q.kind, q.kind), contains=self.canonical_query(q.contains) if q.contains else None, operands=tuple(map(self.canonical_query, q.operands)))

    def select(self, q: Query) -> DataFrame:
        """Matches of ``q``, one row for each identity, with ``captures``; rows of equal identity give the first in document
        order."""
        found = self.targets(self.canonical_query(q))
        keys = [*IDENTITY]
        rest = [c for c in found.columns if c not in keys]
        one = found.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("cand_pre", "node_pre")).alias("r"))
        return one.select(*keys, "r.*")

    def targets(self, q: Query) -> DataFrame:
        """Matches before equal identities are made one: these decide about containment."""
        if (k := q.key()) not in self._seen:
            self._seen[k] = self._targets(q)
        return self._seen[k]

    def _targets(self, q: Query) -> DataFrame:
        if q.op == "or":
            out = self.targets(q.operands[0])
            for x in q.operands[1:]:
                out = out.unionByName(self.targets(x))
            return out
        if q.op == "and":
            out = self.targets(q.operands[0])
            for x in q.operands[1:]:
                out = out.join(self.targets(x).select(*IDENTITY).distinct(), [*IDENTITY], "left_semi")
            return out
        if q.op == "not":
            inner = q.operands[0] if q.operands else Query()
            if inner.op or not inner.kind:
                return self.of_kind(inner.kind or "", "*").filter("false")
            universe = self.targets(Query(inner.kind, "*"))
            return universe.join(self.targets(inner).select(*IDENTITY).distinct(), [*IDENTITY], "left_anti")
        out = self.of_kind(q.kind, q.name)
        for name, value in q.attributes.items():
            out = self.with_attribute(out, name, value)
        if q.contains:
            out = self.with_child(out, q.contains, q.direct) if q.direct else self.with_descendant(out, q.contains)
        return out

    def of_kind(self, kind: str, name: str) -> DataFrame:
        e = self.elements
        if "cand_pre" not in e.columns:
            e = e.withColumn("cand_pre", F.col("pre"))
        out = e.filter(self.is_kind(kind) & patterns.matches(F.col("name"), name)).withColumn("kind", F.lit(kind)).withColumnRenamed("pre", "node_pre")
        found = patterns.captures(F.col("name"), name) if "$" in name else {}
        pairs = [x for k, v in found.items() for x in (F.lit(k), v)]
        return out.withColumn("captures", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))

    def is_kind(self, kind: str) -> Column:
        """A condition on elements."""
        hit = F.col("node_type").isin(*self.kinds.get(kind, (kind,)))
        if "is_target" in self.elements.columns:
            hit = hit & F.col("is_target")
        if "only" in self.elements.columns:
            hit = hit & (F.col("only").isNull() | F.array_contains("only", kind))
        return hit & self.checks[kind] if kind in self.checks else hit

    def select_all(self, queries: list[Query]) -> DataFrame:
        """``select`` of many selectors in one pass over the elements: matches with ``step``, the number of their selector, without
        captures. Rows of equal identity and step give the first in document order.

        Selectors are indexed by the node types of their kind, and a name is tried by the literal that a pattern begins
        with before the pattern is. Those with containment, siblings or operators are planned by themselves.
        """
        queries = [self.canonical_query(q) for q in queries]
        plain = [k for k, q in enumerate(queries) if q.kind and not (q.op or q.contains or {"before", "after"} & set(q.attributes))]
        e = self.elements if "cand_pre" in self.elements.columns else self.elements.withColumn("cand_pre", F.col("pre"))
        by_type: dict[str, list[int]] = {}
        for k in plain:
            for t in self.kinds.get(queries[k].kind, (queries[k].kind,)):
                by_type.setdefault(t, []).append(k)

        def tried(k: int) -> Column:
            q = queries[k]
            prefix = patterns.literal_prefix(q.name)
            hit = self.is_kind(q.kind)
            for c in [F.col("name").startswith(prefix)] * bool(prefix) + [patterns.matches(F.col("name"), q.name)] + [self.attribute(n, v) for n, v in q.attributes.items()]:
                hit = hit & c
            return F.when(hit, F.lit(k))

        steps = F.array().cast("array<int>")
        if by_type:
            first, *more = by_type.items()
            matched = lambda ks: F.filter(F.array(*map(tried, ks)), lambda x: x.isNotNull())
            steps = F.when(F.col("node_type") == first[0], matched(first[1]))
            for t, ks in more:
                steps = steps.when(F.col("node_type") == t, matched(ks))
        kinds = F.array(*[F.lit(q.kind) for q in queries])
        found = e.withColumn("step", F.explode(steps)).withColumn("kind", F.get(kinds, F.col("step"))).withColumnRenamed("pre", "node_pre")
        for k in sorted({*range(len(queries))} - {*plain}):
            found = found.unionByName(self.targets(queries[k]).drop("captures").withColumn("step", F.lit(k)), allowMissingColumns=True)
        keys = [*IDENTITY, "step"]
        rest = [c for c in found.columns if c not in keys]
        return found.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("cand_pre", "node_pre")).alias("r")).select(*keys, "r.*")

    def with_attribute(self, out: DataFrame, name: str, value: str) -> DataFrame:
        if name in ("before", "after"):
            return self.beside(out, value, name == "before")
        return out.filter(self.attribute(name, value))

    def attribute(self, name: str, value: str) -> Column:
        """A condition on elements; attributes that are not known hold."""
        if name == "text":
            return patterns.text_matches(F.col("text"), value)
        if name == "source":
            return patterns.text_matches(F.col("text"), value) | patterns.text_matches(F.col("name"), value)
        if name.startswith("arg"):
            return self.argument(name[3:], value)
        if name == "type" and self.typed:
            return (F.col("decl_type") != "") & patterns.matches(F.col("decl_type"), value) if value != "*" else F.col("decl_type") != ""
        if name in self.columns:
            return patterns.matches(F.col(name).cast("string"), value)
        return F.lit(True)

    @staticmethod
    def argument(number: str, value: str) -> Column:
        """Empty arguments are gone before the others are counted."""
        args = F.filter(F.coalesce(F.col("args"), F.array().cast("array<string>")), lambda a: patterns.trimmed(a) != "")
        if not number:
            return F.exists(args, lambda a: patterns.text_matches(a, value))
        if not number.isdigit():
            return F.lit(False)
        return F.coalesce(patterns.text_matches(F.get(args, F.lit(int(number))), value), F.lit(False))

    def with_descendant(self, out: DataFrame, child: Query) -> DataFrame:
        """A match of ``child`` strictly below the bound node: the next match in document order lies within the subtree.

        For simple children the candidate decides about being inside the subtree and the bound node about being contained.
        """
        inner = self.points(child, "cand_pre", "cand_pre")
        return _reaching(out, F.col("node_pre"), F.col("last"), inner, F.min, later=True, holds=lambda x, last: x <= last)

    def points(self, q: Query, at: str, value: str) -> DataFrame:
        """doc, at and value of the targets of ``q``; written once if they are more than filtered elements."""
        found = self.targets(q).select("doc", F.col(at).cast("long").alias("at"), F.col(value).cast("long").alias("value"))
        plain = not (q.op or q.contains or {"before", "after"} & set(q.attributes))
        return found if plain else written(found, "points")

    def nodes(self) -> DataFrame:
        """doc, pre, up (the parent) and through (whether it stands for its children) of nodes that have a parent."""
        e = self.elements.filter("is_node") if "is_node" in self.elements.columns else self.elements
        return e.select("doc", "pre", F.col("parent").alias("up"), F.col("node_type").isin(*self.transparent).alias("through")).filter("up is not null")

    def with_child(self, out: DataFrame, child: Query, direct: bool = True) -> DataFrame:
        """A match of ``child`` among the raw children, but for containers, whose own children take their place. Edges are
        those of matches only, one step up and, where that ends at a container, another."""
        if child.op:
            return out.filter("false")
        found = self.targets(child).select("doc", F.col("cand_pre").alias("pre")).distinct()
        edges = self.nodes().join(found, ["doc", "pre"], "left_semi").select("doc", "up", "through")
        above = edges.filter("not through").select("doc", "up")
        if self.transparent:
            holders = self.nodes().filter("through").select("doc", F.col("pre").alias("up"), F.col("up").alias("above"))
            above = above.unionByName(edges.join(holders, ["doc", "up"]).select("doc", F.col("above").alias("up")))
        above = above.distinct().select(F.col("doc").alias("d"), "up")
        return out.join(above, (F.col("doc") == F.col("d")) & (F.col("node_pre") == F.col("up")), "left_semi")

    def beside(self, out: DataFrame, selector: str, before: bool) -> DataFrame:
        """A target of ``selector`` in the subtree of a sibling, all of it after (before) this one; selectors that cannot be
        parsed match nothing, and kinds in them are not canonical.

        Bytes follow document order. So before: of the targets up to the parent's end, the one that starts last starts
        behind this node (those outside the parent's subtree begin earlier). After: of the targets behind the parent, the
        one that ends first ends ahead of this node (those outside the subtree end later).
        """
        from copse.selector import SelectorError, parse

        try:
            q = parse(selector)
        except SelectorError:
            return out.filter("false")
        out = out.filter("parent is not null")
        if not before:
            return _reaching(out, F.col("parent"), F.col("start_byte"), self.points(q, "node_pre", "end_byte"), F.min, later=True, holds=lambda x, start: x < start)
        parents = self.elements.select(F.col("doc").alias("pd"), F.col("pre").alias("pp"), F.col("last").alias("pl")).distinct()
        placed = out.join(parents, (F.col("doc") == F.col("pd")) & (F.col("parent") == F.col("pp"))).drop("pd", "pp")
        return _reaching(placed, F.col("pl"), F.col("end_byte"), self.points(q, "node_pre", "start_byte"), F.max, later=False, holds=lambda x, end: x > end).drop("pl")

    def enclosing(self, matches: DataFrame, q: Query, carry: tuple[str, ...] = ()) -> DataFrame:
        """``matches`` with ``scope``: the matches of ``q`` that enclose each, from the outermost to the nearest, as structs
        of kind, name, pre and the columns ``carry`` of the elements.

        Places are sorted once and passed through with a stack of the intervals that are open; nothing but places, names and
        what is carried takes part. Documents are split into spans as for containment, each of which starts with the
        intervals that reach into it.
        """
        span = lambda c: F.shiftright(F.col(c), SPAN)
        info = F.struct("kind", "name", F.col("node_pre").alias("pre"), *carry)
        holders = self.targets(self.canonical_query(q)).select("doc", F.col("node_pre").cast("long").alias("at"), F.col("last").cast("long").alias("last"), info.alias("info")).dropDuplicates(["doc", "at", "last"])
        rows = matches.select("doc", F.col("node_pre").cast("long").alias("at")).distinct()
        rows = rows.select("doc", span("at").alias("span"), "at", F.lit(None).cast("long").alias("last"), F.lit(None).cast(holders.schema["info"].dataType).alias("info"))
        wide = holders.filter(span("at") < span("last")).select(F.col("doc").alias("d"), "at", "last", "info")
        into = rows.select("doc", "span").distinct().join(wide, F.col("doc") == F.col("d")).filter((F.col("span") > span("at")) & (F.col("span") <= span("last")))
        own = holders.select("doc", span("at").alias("span"), "at", "last", "info")
        passed = rows.unionByName(own).unionByName(into.select("doc", "span", "at", "last", "info"))
        # at one place what is asked for comes before what opens there, and the longer interval before the shorter
        sorted_ = passed.repartition("doc", "span").sortWithinPartitions("doc", "span", "at", F.col("last").isNotNull(), F.desc("last"))
        schema = T.StructType([matches.schema["doc"], T.StructField("at", T.LongType()), T.StructField("scope", T.ArrayType(holders.schema["info"].dataType))])
        found = sorted_.mapInArrow(_stacks(schema), schema).select(F.col("doc").alias("of"), "at", "scope")
        return matches.join(found, (F.col("doc") == F.col("of")) & (F.col("node_pre") == F.col("at")), "left").drop("of", "at")

    def inherited(self, matches: DataFrame, column: str, q: Query) -> DataFrame:
        """``matches`` with ``inherited``: their own ``column`` or, where it is null, that of the nearest enclosing match of ``q``
        that has one."""
        found = self.enclosing(matches, q, (column,))
        given = F.element_at(F.filter("scope", lambda x: x[column].isNotNull()), -1)
        nearest = F.when(F.exists("scope", lambda x: x[column].isNotNull()), given[column])
        return found.withColumn("inherited", F.coalesce(column, nearest)).drop("scope")

    def errors(self) -> DataFrame:
        """Documents with a node of type ERROR, and where the first begins (1-based)."""
        bad = self.elements.filter("node_type = 'ERROR'")
        text = F.format_string("Syntax error at line %d, column %d", F.col("start_row") + 1, F.col("start_col") + 1)
        return bad.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_byte", text.alias("message")))), lambda x: x["message"]).alias("errors"))

    def valid(self) -> Forest:
        """The forest without documents that have errors: what a query reads. Their rows are ``errors()``."""
        from dataclasses import replace

        bad = self.errors().select("doc")
        return replace(self, elements=self.elements.join(bad, "doc", "left_anti"), _seen={})


def placed(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """``matches`` with start_row, start_col, end_row and end_col (from 0; columns in bytes) of their bytes in ``texts`` (doc,
    text; one row for each document). A document's matches meet its index of line starts once, whatever their number."""
    made = ("start_row", "start_col", "end_row", "end_col")
    kept = [c for c in matches.columns if c not in made]
    of = matches.groupBy("doc").agg(F.collect_list(F.struct(*kept)).alias("found"))
    starts = texts.join(of.select("doc"), "doc", "left_semi").select("doc", places.line_starts(F.col("text")).alias("starts"))
    at = lambda x: F.struct(*[x[c].alias(c) for c in kept], places.place(F.col("starts"), x["start_byte"]).alias("from"), places.place(F.col("starts"), x["end_byte"]).alias("to"))
    out = of.join(starts, "doc").select(F.explode(F.transform("found", at)).alias("m"))
    return out.select(*[F.col(f"m.{c}").alias(c) for c in kept], F.col("m.from.row").alias("start_row"), F.col("m.from.col").alias("start_col"), F.col("m.to.row").alias("end_row"), F.col("m.to.col").alias("end_col"))


def projected(matches: DataFrame) -> DataFrame:
    """Matches as they are reported: 1-based rows and columns, content, captures."""
    return matches.select(
        "doc", F.col("kind").alias("type"), "name", F.col("text").alias("content"),
        (F.col("start_row") + 1).alias("line"), (F.col("start_col") + 1).alias("column"), (F.col("end_row") + 1).alias("end_line"), (F.col("end_col") + 1).alias("end_column"),
        "captures", "start_byte", "end_byte",
    )
