"""Compiled selectors against a walk over random forests in plain Python, and rewriting, patterns and scores."""

import random

import pytest
from pyspark.sql import functions as F

from copse.functions import patterns, scalars
from copse.operators import recipe, rewrite, score
from copse.plans.forest import Forest
from copse.selector import parse

SCHEMA = "doc long, pre long, last long, parent long, node_type string, name string, start_byte long, end_byte long, text string, args array<string>"


def grow(rng, doc):
    """Nodes of a random tree in document order; spans nest."""
    nodes = []

    def node(parent, depth):
        pre = len(nodes)
        nodes.append(None)
        start = 2 * pre
        kids = rng.randint(0, 3) if depth < 4 else 0
        for _ in range(kids):
            node(pre, depth + 1)
        nodes[pre] = (doc, pre, len(nodes) - 1, parent, rng.choice(["a", "b", "c", "block"]), rng.choice("xyz"), start, 2 * len(nodes) - 1, "", [])

    node(None, 0)
    return nodes


def walk(nodes, q):
    """The same by recursion: rows of one document that match."""
    by_pre = {n[1]: n for n in nodes}
    kids = lambda p: [n for n in nodes if n[3] == p]
    key = lambda k, n: (k, n[6], n[7], n[5])

    def match(q, among):
        if q.op == "or":
            return [m for x in q.operands for m in match(x, among)]
        if q.op == "and":
            first, *rest = (match(x, among) for x in q.operands)
            return [m for m in first if all(key(*m) in {key(*o) for o in r} for r in rest)]
        if q.op == "not":
            inner = q.operands[0]
            if inner.op:
                return []
            gone = {key(*m) for m in match(inner, among)}
            return [(inner.kind, n) for n in among if n[4] == inner.kind and key(inner.kind, n) not in gone]
        out = []
        for n in among:
            if n[4] != q.kind or (q.name not in ("", "*") and n[5] != q.name):
                continue
            if q.contains and not q.direct and not match(q.contains, [by_pre[i] for i in range(n[1] + 1, n[2] + 1)]):
                continue
            if q.contains and q.direct:
                direct = [g for c in kids(n[1]) for g in (kids(c[1]) if c[4] == "block" else [c])]
                if q.contains.op or not any(m[1] in direct for m in match(q.contains, nodes)):
                    continue
            out.append((q.kind, n))
        return out

    return {(n[0], k, n[6], n[7], n[5]) for k, n in match(q, nodes)}


SELECTORS = ["a:*", "a:x > b:*", "a:* >> b:*", "a:* > b:* > c:*", "a:* >> b:y >> c:*", "a:x | b:y", "a:* & a:x", "a:* & b:*", "!a:x", "a:* > !b:x", "(a:* | b:*) > c:x", "a:* > (b:x | c:y)", "a:* >> (b:x | c:y)", "!(a:* | b:*)", "a:* >> block:*", "!a:x > b:*"]


@pytest.fixture(scope="module")
def forests(spark):
    rng = random.Random(7)
    trees = {d: grow(rng, d) for d in range(60)}
    return trees, spark.createDataFrame([n for t in trees.values() for n in t], SCHEMA).cache()


@pytest.mark.parametrize("selector", SELECTORS)
def test_against_a_walk(forests, selector):
    trees, elements = forests
    q = parse(selector)
    got = {tuple(r) for r in Forest(elements).select(q).select("doc", "kind", "start_byte", "end_byte", "name").collect()}
    assert got == set().union(*(walk(t, q) for t in trees.values()))


def test_expanded_nodes_decide_below_their_own_place(spark):
    """A declaration that binds two names: containment looks below the bound node, so a call beside it is not below."""
    rows = [(1, 0, 3, None, "var", "x", 0, 1, "", [], 0, True), (1, 3, 3, 0, "call", "f", 5, 8, "", [], 3, True)]
    e = spark.createDataFrame(rows, SCHEMA + ", cand_pre long, is_target boolean").withColumn("last", F.when(F.col("node_type") == "var", 0).otherwise(F.col("last")).cast("long"))
    assert Forest(e).select(parse("var:x > call:f")).count() == 0


def test_name_patterns(spark):
    got = lambda pattern, text: spark.range(1).select(patterns.matches(F.lit(text), pattern)).first()[0]
    for pattern, want in {"TestFunc": True, "Test*": True, "*Func": True, "Test*Func": True, "OtherFunc": False, "": True, "*": True, "[": False, "T[a-f]st*": True, "T[^e]st*": False, "Test\\Func": True}.items():
        assert got(pattern, "TestFunc") is want, pattern
    assert not got("net*", "net/http") and got("net$rest", "net/http") and got("a?c", "abc") and not got("a?c", "a/c")


def test_captures(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in patterns.captures(F.lit("a.b.fetch"), "$client.$method").items()]).first()
    assert (r.client, r.method) == ("a", "b.fetch")


def test_path_globs(spark):
    def got(glob, path):
        return spark.range(1).select(patterns.glob_matches(F.lit(path), glob)).first()[0]

    for glob, path, want in [("**/*.go", "main.go", True), ("**/*.go", "a/b/main.go", True), ("*.go", "a/main.go", True), ("src/*.go", "src/a/b.go", False), ("src/**", "src/a/b.go", True), ("src/**/*.go", "src/b.go", True), ("**", "a/b", True), ("*.{js,ts}", "x.ts", True), ("a/*", "a/b/c", False)]:
        assert got(glob, path) is want, (glob, path)
    scoped = spark.createDataFrame([("a/x.go",), ("vendor/y.go",), ("b/vendor/z.go",), ("c.py",)], "p string")
    assert [r.p for r in scoped.filter(patterns.in_scope(F.col("p"), ["**/*.go"], ["vendor"])).collect()] == ["a/x.go"]


def docs(spark, *texts):
    rows = []
    for d, t in enumerate(texts):
        rows.append((d, 0, 99, None, "document", str(d), 0, len(t.encode()), t, []))
        at = 0
        for k, line in enumerate(t.split("\n")):
            rows.append((d, k + 1, k + 1, 0, "line", line, at, at + len(line.encode()), line, []))
            at += len(line.encode()) + 1
    return Forest(spark.createDataFrame(rows, SCHEMA))


def test_splice(spark):
    edits = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), rewrite.binary(F.lit("X")).alias("new")) for a, b in ((1, 3), (4, 6))])
    assert spark.range(1).select(F.decode(rewrite.splice(rewrite.binary(F.lit("abcdef")), edits), "UTF-8")).first()[0] == "aXdX"


@pytest.mark.parametrize("method,want", [("replace", "é\nnew\n  ü"), ("delete", "é\n\n  ü"), ("insert_before", "é\n  new\n  hit\n  ü"), ("insert_after", "é\n  hit\n  new\n  ü"), ("append", "é\n  hit\n\nnew\n  ü")])
def test_methods(spark, method, want):
    r = rewrite.with_diff(rewrite.transform(docs(spark, "é\n  hit\n  ü"), method, parse("line:*hit"), "new")).first()
    assert r.modified == want and r.match_count == 1 and "+" in r.diff


def test_confidence(spark):
    f = docs(spark, "\n".join(["Test a"] * 6 + ["rest " * 20]))
    r = rewrite.transform(f, "replace", parse("line:Test*"), "Test b", exported=F.lit(True)).first().confidence
    assert round(r.score, 9) == 0.25 and r.level == "low" and [x.name for x in r.factors][0] == "multiple_targets"
    one = rewrite.transform(docs(spark, "abcdef\n" * 5 + "hit"), "replace", parse("line:hit"), "hot").first().confidence
    assert (one.score, one.level) == (1.0, "high")


def test_rollup(spark):
    def level(*rows):
        return score.rollup(spark.createDataFrame(list(rows), "modified boolean, score double, error string")).first()

    assert level(*[(True, 0.9, "")] * 15).level == "high"
    assert level((False, 0.9, "")).score == 0.0
    assert level((True, 0.9, ""), (True, 0.0, "lost")).level == "medium"


def test_recipe_gate(spark):
    spec = {"name": "r", "steps": [{"name": "s", "method": "delete", "dsl": "line:a*"}]}
    steps, least = recipe.validated(spec)
    with pytest.raises(recipe.RecipeError, match="confidence"):
        recipe.execute(docs(spark, "a\nb"), steps, threshold=least)
    with pytest.raises(recipe.RecipeError, match="unsupported method"):
        recipe.validated({"name": "r", "steps": [{"method": "rename"}]})


def test_pages_of_results(spark):
    first, cursor = scalars.page(spark.range(10), ["id"], "", 4)
    assert [r.id for r in first.collect()] == [0, 1, 2, 3] and cursor == "4"
    with pytest.raises(ValueError):
        scalars.page(spark.range(1), ["id"], "x")


@pytest.mark.parametrize("selector", ["a:* before=b:x", "a:* after=b:x", "b:* before=a:*", "c:x after=c:*"])
def test_siblings_against_a_walk(forests, selector):
    """Targets below the same parent that begin behind (end ahead of) the node."""
    trees, elements = forests
    q = parse(selector)
    (where, value), = q.attributes.items()
    kind, name = value.split(":")
    want = set()
    for nodes in trees.values():
        by_pre = {n[1]: n for n in nodes}
        for n in nodes:
            if n[4] == q.kind and q.name in ("*", n[5]) and n[3] is not None:
                up = by_pre[n[3]]
                targets = [t for t in nodes if t[4] == kind and name in ("*", t[5]) and up[1] < t[1] <= up[2]]
                if any(t[6] > n[7] if where == "before" else t[7] < n[6] for t in targets):
                    want.add((n[0], n[1]))
    assert want and {(r.doc, r.node_pre) for r in Forest(elements).select(q).collect()} == want


def test_spans_of_large_documents(forests, monkeypatch):
    """Documents that are split into spans give what whole ones give."""
    from copse.plans import forest

    trees, elements = forests
    selectors = ["a:* > b:x", "a:* > b:* > c:*", "a:* before=b:x", "a:* after=b:x"]
    rows = lambda: [sorted((r.doc, r.node_pre) for r in Forest(elements).select(parse(s)).collect()) for s in selectors]
    whole = rows()
    monkeypatch.setattr(forest, "SPAN", 1)
    assert rows() == whole


def test_running_sums(spark):
    from copse.sources import tables

    cases = [[], [5], list(range(10)), [1] * 513, list(range(1000))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x array<long>").withColumn("s", tables.running(F.col("x")))
    assert {r.i: r.s for r in df.collect()} == {i: [sum(x[: k + 1]) for k in range(len(x))] for i, x in enumerate(cases)}


def test_diff_of_long_texts():
    """What both texts begin and end with is set aside; the rest is the usual diff."""
    import difflib

    rng = random.Random(3)
    for _ in range(60):
        a = [rng.choice("abc") + str(i) for i in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = ["new"] * rng.randint(0, 2)
        want = "\n".join(difflib.unified_diff(a or [""], b or [""], "original", "modified", lineterm="")) if a != b else ""
        assert rewrite.unified("\n".join(a), "\n".join(b)) == want
    long = "\n".join(map(str, range(200_000)))
    assert "@@ -100001,7" not in rewrite.unified(long, long.replace("\n100000\n", "\nx\n")).split("\n")[0]
    assert rewrite.unified(long, long.replace("\n100000\n", "\nx\n")).split("\n")[2] == "@@ -99998,7 +99998,7 @@"


def test_plans_do_not_grow_with_levels(spark):
    """Each level of containment reads what is below from a table, so that the last plan is the same for any depth."""
    import re

    from copse.sources import tables

    def exchanges(selector):
        plan = tables.customers(spark, "/root/testdata/sf0.001").select(parse(selector))._jdf.queryExecution().executedPlan().toString()
        return len(re.findall("Exchange", plan)), len(re.findall("FileScan", plan))

    counts = [exchanges("customer:*" + " > order:*" * k + " > line:*") for k in range(4)]
    assert counts[1] == counts[2] == counts[3] and counts[0][0] <= counts[1][0] + 4 and counts[1][0] <= 8


def test_places_that_do_not_fit_are_an_error(spark, tmp_path):
    from pyspark.errors import PySparkException

    from copse.sources import tables

    for name in ("customer", "orders", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df = df.withColumn("o_orderkey", F.col("o_orderkey") - 5) if name == "orders" else df
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    with pytest.raises(PySparkException, match="no place"):
        tables.customers(spark, str(tmp_path)).select(parse("order:*")).collect()


def test_all_selectors_in_one_pass(spark):
    """The same matches as one by one, whatever the selectors; one pass over the elements for those without containment."""
    rng = random.Random(21)
    rows = [n for doc in range(12) for n in grow(rng, doc)]
    f = Forest(spark.createDataFrame(rows, SCHEMA), kinds={"any": ("a", "b")}, canonical={"x": "a"})
    selectors = ["a:*", "b:n*", "x:*", "any:*", "a:[m-n]*", "c:none", "a:* > b:*", "a:* | b:*", "!a:n*", "a:* before=b:*", "b:* text=t", "a:* color=none"]
    queries = [parse(x) for x in selectors]
    cells = lambda df: sorted(str(tuple(r)) for r in df.select("doc", "kind", "start_byte", "end_byte", "name", "node_pre").collect())
    found = f.select_all(queries).cache()
    for k, q in enumerate(queries):
        assert cells(found.filter(F.col("step") == k)) == cells(f.select(q)), selectors[k]
    plan = f.select_all([parse(f"a:n{i}*") for i in range(10)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_documents_that_fail(spark):
    """One that cannot be read costs 0.2, counts as scanned, and fails nothing."""
    steps = [recipe.Step("one", "replace", parse("line:a"), "b"), recipe.Step("none", "delete", parse("line:zzz"))]
    forest = docs(spark, "a\nc")
    failed = spark.createDataFrame([("gone.go", "No such file")], "doc string, error string")
    good = {r.step: r for r in recipe.preview(forest, steps).collect()}
    bad = {r.step: r for r in recipe.preview(forest, steps, failed).collect()}
    assert abs(good["one"].score - bad["one"].score - 0.2) < 1e-9 and (bad["one"].modified, bad["one"].matches) == (1, 1)
    assert (good["one"].scanned, bad["one"].scanned, bad["none"].scanned) == (1, 2, 2) and bad["none"].modified == bad["none"].matches == 0


def test_json_with_defaults(spark):
    """Keys that are given win, nulls too; what is no object counts as none; values are kept as they are."""
    rows = ['{"k": 9}', '{"a": {"b":[1,2]}, "z": null, "k":"x"}', None, "", "[1]", "{bad", "7", '{"it\'s \\"": 1.5}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: r.o for r in df.select("i", scalars.with_defaults(F.col("t"), {"k": 1, "mode": "dry"}).alias("o")).collect()}
    none = '{"k":1,"mode":"dry"}'
    assert got == {0: '{"k":9,"mode":"dry"}', 1: '{"a":{"b":[1,2]},"k":"x","mode":"dry","z":null}', 2: none, 3: none, 4: none, 5: none, 6: none, 7: '{"it\'s \\"":1.5,"k":1,"mode":"dry"}'}
