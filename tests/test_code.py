"""Parsers, selections over source code, appending, folders as sources."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from copse.operators import append, rewrite
from copse.providers import catalog
from copse.providers.tree import COLUMNS, numbered, rows
from copse.selector import parse
from copse.sources import files

CODE = {
    "go": {
        "main.go": 'package main\n\nimport "os"\n\ntype User struct {\n\tSecret string\n}\n\ntype Other struct {\n\tSecret int\n}\n\ntype Reader interface {\n\tRead() int\n}\n\n'
                   'func Load() string {\n\treturn os.Getenv("X")\n}\n\nfunc helper() {\n\tvar alpha, beta int\n\tx := run(alpha)\n\tuse(x, beta)\n}\n',
    },
    "python": {
        "app.py": "import os, sys as s\nfrom a.b import c as d, e\n\n\n# zażółć\ndef load_token():\n    return os.getenv('T')\n\n\nasync def other():\n    a, b = 1, 2\n    obj.x = 2\n\n\nclass K:\n    def load_user(self):\n        pass\n",
    },
    "javascript": {
        "ui.js": "class UserController {\n  constructor() { this.a = 1; }\n  render() { return api.fetch('/x'); }\n}\nfunction first() { fetch(\"/api/user\"); }\nfunction second() { fetch(\"/b\"); }\n"
                 "const foo = 1;\nconst { m, n: o } = require('q');\nconst go = async (x) => x / 2;\n",
    },
    "typescript": {
        "svc.ts": "export class UserService<T> {\n  private items: Array<Map<string, T>> = [];\n  get value(): string { return 'a'; }\n  value2(): void {}\n  async loadUser(): Promise<void> { await fetch('a'); }\n}\n"
                  "interface Shape { name: string; area(): number }\nenum Color { Red, Green }\nexport function isA(x: any): x is string { return x >> 2 > 1; }\n",
    },
    "php": {
        "a.php": "<?php\nnamespace App;\nuse A\\B, C\\D as E;\nclass Formatter {\n  public $foo, $bar;\n  public function __construct() { }\n  public function format(string $x) { return strtoupper($x); }\n  public function plain() { return 1; }\n}\n"
                 "[$p, $q] = pair();\n$f = function ($z) { return $z; };\n",
    },
}
JSX = (
    "export default function App({ items }) {\n  if (n < 1 && i++ < n) return null;\n  return (\n    <Box.Outer title=\"it's\" {...rest()} onClick={() => press(1)}>\n      Don't {/* note */} call(this) {n > 1 ? <b>{format(n)}</b> : '}'}\n"
    "      <>{items.map(x => <Row key={x.id} v={`t${id(x)}`} re={/}>/.test(x)} />)}</>\n    </Box.Outer>\n  );\n}\nfunction plain() { return a < b > c; }\n"
)
CASES = [
    ("go", "func:* > call:os.Getenv", ["Load"]), ("go", "struct:* > field:Secret string", ["User"]), ("go", "def:Load", []), ("go", "return:*", ["anonymous"]), ("go", "var:beta", ["beta"]),
    ("go", "struct:*", ["Other", "User"]), ("go", "iface:*", ["Reader"]), ("go", "import:*", ["os"]), ("go", "func:* & import:os", []), ("go", "var:x", ["x"]), ("go", "assign:*", ["x"]), ("go", "var:x > call:run", []),
    ("go", "!func:L*", ["helper"]), ("python", "def:load_*", ["load_token", "load_user"]), ("python", "def:* > call:os.getenv", ["load_token"]), ("python", "func:", ["load_token", "load_user", "other"]),
    ("python", "class:*", ["K"]), ("python", "return:*", ["return"]), ("python", "var:*", ["a", "b"]), ("python", "import:*", ["d", "e", "os", "s"]), ("python", "comment:*", ["zażółć"]),
    ("python", "class:K >> method:load_user", ["K"]), ("javascript", "func:* > call:fetch", ["first", "second"]), ("javascript", "call:fetch arg0=\"/api/user\"", ["fetch"]),
    ("javascript", "class:UserController >> method:render", ["UserController"]), ("javascript", "func:first before=func:second", ["first"]), ("javascript", "func:second before=func:first", []),
    ("javascript", "ctor:*", ["constructor"]), ("javascript", "variable:foo", ["foo"]), ("javascript", "variable:*", ["foo", "go", "m", "o"]), ("javascript", "arrow:*", ["go"]),
    ("typescript", "func:* > call:fetch", ["loadUser"]), ("typescript", "getter:*", ["value"]), ("typescript", "interface:*", ["Shape"]), ("typescript", "member:*", ["Green", "Red"]), ("typescript", "field:items", ["items"]),
    ("php", "method:* > call:strtoupper", ["format"]), ("php", "property:foo", ["foo"]), ("php", "ctor:*", ["__construct"]), ("php", "use:*", ["A\\B", "E"]), ("php", "assign:*", ["f", "p", "q"]), ("php", "closure:*", ["f"]),
]


@pytest.fixture(scope="module")
def docs(spark):
    from functools import reduce

    from pyspark.sql import DataFrame

    return reduce(DataFrame.unionByName, [files.inline(spark, lang, **sources) for lang, sources in CODE.items()])


@pytest.fixture(scope="module")
def elements(docs):
    return files.parsed(docs).cache()


@pytest.fixture(scope="module")
def forests(elements):
    return {x: files.forest(elements, x) for x in catalog.LANGUAGES}


@pytest.mark.parametrize(("language", "selector", "expected"), CASES)
def test_selectors(forests, language, selector, expected):
    assert sorted(r["name"] for r in forests[language].select(parse(selector)).select("name").collect()) == expected


def test_captures_and_kinds(elements):
    found = files.select(elements, parse("call:$client.fetch")).collect()
    assert [r["captures"]["client"] for r in found] == ["api"]
    kinds = files.select(elements, parse("fn:load*")).select("kind", "doc").collect()
    assert {tuple(r) for r in kinds} == {("function", "app.py"), ("function", "svc.ts")}


@pytest.mark.parametrize("language", catalog.LANGUAGES)
def test_trees_nest_and_cover(language):
    """Children lie inside their parents, numbers follow the order of spans, and spans of bytes cut the text itself."""
    parse_, module = files.parser(language)
    for text in [*CODE[language].values(), JSX, "", "\n", "é", "}{)(", "a = (", "x" * 10_000, "(" * 5_000, 'class { "', "func f( {", "<?php function f( {"]:
        root = parse_(text)
        for n in numbered(root):
            assert 0 <= n.start <= n.end <= len(text) and n.pre <= n.last
            assert all(n.start <= k.start and k.end <= n.end for k in n.kids), (language, text[:20], n.type)
        for r in rows(root, text, module):
            r = dict(zip(COLUMNS, r))
            assert text.encode()[r["start_byte"] : r["end_byte"]].decode() == r["text"]


def test_jsx(spark):
    """Elements are parts of expressions: what is in braces is code, the text around it is not; comparisons stay such."""
    e = files.parsed(files.inline(spark, "javascript", a=JSX, flat="if (a <b && c> d) { go(x); }\n", bad="const x = <p>{f(}</p>;\n"))
    assert [r["doc"] for r in files.rejects(e).collect()] == ["bad"]
    names = lambda q: sorted(r["name"] for r in files.select(e, parse(q)).filter("doc <> 'flat'").select("name").collect())
    assert names("func:* > call:format") == ["App"] and names("func:plain > call:*") == []
    assert names("call:*") == sorted(["rest", "press", "format", "items.map", "id", "/}>/.test"])
    assert [r["name"] for r in files.select(e, parse("call:go")).collect()] == ["go"]
    nodes = {r["node_type"]: r["n"] for r in e.filter("doc = 'a' and is_node").groupBy("node_type").agg(F.count("*").alias("n")).collect()}
    assert (nodes["jsx_element"], nodes["jsx_self_closing_element"], nodes["jsx_attribute"]) == (3, 1, 5) and nodes["comment"] == 1
    nested = files.forest(files.parsed(files.inline(spark, "typescript", a="function f() { return `a${g(`b${h(1)}`)}}` + tag`${x as T}`; }\nconst { q } = { q: `\\`${k()}` };\n")), "typescript")
    assert sorted(r["name"] for r in nested.select(parse("call:*")).select("name").collect()) == ["g", "h", "k", "tag"]
    root = files.parser("javascript")[0]("x = " + "<b>" * 5_000 + "f(1)" + "</b>" * 5_000 + "; f(" + "<a " * 5_000)
    assert any(n.type == "ERROR" for n in numbered(root))


def test_errors(spark):
    docs = files.inline(spark, "python", bad="def f(:\n", good="x = 1\n").unionByName(files.inline(spark, "go", worse="package a\nfunc f( {\n"))
    e = files.parsed(docs)
    assert {r["doc"] for r in files.rejects(e).collect()} == {"bad", "worse"}
    assert files.rejects(e).filter("doc = 'bad'").first()["errors"][0].startswith("Syntax error at line 1, column ")
    assert [r["doc"] for r in files.select(e, parse("var:*")).collect()] == ["good"]


def test_rewriting(elements):
    one = files.transform(elements, "replace", parse("def:load_token"), "def load_secret(): pass", ("python",)).first()
    assert "load_secret" in one["modified"] and "load_token" not in one["modified"] and one["match_count"] == 1
    assert {f["name"] for f in one["confidence"]["factors"]} >= {"single_target", "exported_api"} and one["confidence"]["score"] == pytest.approx(0.9 if abs(len(one["modified"]) / len(one["original"]) - 1) <= 0.3 else 0.8)
    broken = files.transform(elements, "replace", parse("def:load_token"), "def (", ("python",)).first()
    assert "post_validation_failed" in {f["name"] for f in broken["confidence"]["factors"]}
    marked = files.transform(elements, "insert_before", parse("property:foo"), "/* mark */", ("php",)).first()
    assert marked["modified"].count("mark") == 1
    assert "+" in rewrite.with_diff(files.transform(elements, "delete", parse("func:Load"), "", ("go",))).first()["diff"]


CLASS = "export class UserService {\n  findAll() {\n    return [];\n  }\n}\n"
GROWN = "export class UserService {\n  findAll() {\n    return [];\n  }\n\n  async create() {\n    return { ok: true };\n  }\n}\n"


@pytest.mark.parametrize("selector", ["class:UserService", ""])
def test_append_to_class(spark, selector):
    from copse.selector import Query

    e = files.parsed(files.inline(spark, "typescript", s=CLASS))
    q = parse(selector) if selector else Query()
    assert files.transform(e, "append", q, "\n  async create() {\n    return { ok: true };\n  }\n", ("typescript",)).first()["modified"] == GROWN


@pytest.mark.parametrize(("content", "expected"), [
    ('"fmt"', 'package a\n\nimport "os"\n\nimport "fmt"\n\n\nfunc f() {}\n\nvar x = 1\n'),
    ("func g() {}", 'package a\n\nimport "os"\n\nfunc f() {}\n\nfunc g() {}\n\n\nvar x = 1\n'),
    ("var y = 2", 'package a\n\nimport "os"\n\nfunc f() {}\n\nvar x = 1\n\nvar y = 2\n\n'),
    ("type T int", 'package a\n\nimport "os"\n\ntype T int\n\n\nfunc f() {}\n\nvar x = 1\n'),
    ("// end", 'package a\n\nimport "os"\n\nfunc f() {}\n\nvar x = 1\n\n// end\n'),
])
def test_append_go(content, expected):
    assert append.in_go('package a\n\nimport "os"\n\nfunc f() {}\n\nvar x = 1\n', content) == expected


def test_append_indents():
    assert append.in_typescript("class A {\n}\n", "x = 1") == "class A {\n  x = 1\n}\n"
    assert append.in_typescript("class A {}\n", "const x = 1") == "class A {}\n\nconst x = 1\n"
    assert append.in_typescript("class A {}\nclass B {}", "x") == "class A {}\nclass B {}\n\nx\n"
    assert append.placed("go", "package a", "  ", None) is None


def test_walk(spark, tmp_path):
    for name in ("a.py", "sub/b.go", "sub/deep/c.ts", "node_modules/x.js", "sub/.hidden.txt", "z.md"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    got = lambda **k: sorted(r["path"] for r in files.paths(spark, files.Scope(str(tmp_path), **k)).collect())
    assert got(exclude=("node_modules/**",), include=("**/*.py", "**/*.go", "**/*.ts")) == ["a.py", "sub/b.go", "sub/deep/c.ts"]
    assert got(max_depth=1, include=("*.go", "*.ts")) == ["sub/b.go"]
    assert got(max_files=2, exclude=("z.md", "*.txt")) == ["a.py", "node_modules/x.js"]
    assert "link/b.go" in got(follow_symlinks=True) or "sub/b.go" in got(follow_symlinks=True)
    docs = files.walk(spark, files.Scope(str(tmp_path)))
    assert {(r["language"], r["n"]) for r in files.language_stats(docs).collect()} >= {("python", 1), ("go", 1), ("typescript", 1), ("javascript", 1), ("unknown", 2)}
    row = docs.filter("path = 'a.py'").first()
    assert (row["source"], row["size"], row["doc"]) == ("x = 1\n", 6, str(tmp_path / "a.py"))
    for bad in ("", str(tmp_path / "none"), str(tmp_path / "a.py")):
        with pytest.raises(files.ScopeError):
            files.Scope(bad).checked()


def test_stored(spark, tmp_path):
    docs = files.inline(spark, "python", a="x = 1\n", b="x = 1\n", c="y = 2\n")
    table = str(Path(tmp_path) / "elements")
    first = files.stored(docs.filter("doc != 'c'"), table)
    assert {r["doc"] for r in files.select(first, parse("var:x"), ("python",)).collect()} == {"a", "b"}
    files.stored(docs, table)
    kept = spark.read.parquet(f"{table}/elements")
    assert kept.filter("pre = 0").count() == 2 and kept.filter(F.col("name") == "y").count() > 0


def test_stored_elements_expire(spark, tmp_path):
    """Those that are too old are parsed anew and deleted on demand; hits and misses are counted by texts."""
    docs = files.inline(spark, "python", a="x = 1\n", b="x = 1\n", c="y = 2\n", d="z = 3\n")
    table = f"file://{tmp_path}/store"
    count = lambda some, now: sorted(r["doc"] for r in files.stored(docs.filter(some), table, 60, now).filter("pre = 0").collect())
    assert count("doc in ('a', 'b')", 1000) == ["a", "b"]
    assert count("doc <> 'd'", 1030) == ["a", "b", "c"]
    assert count("true", 1060) == ["a", "b", "c", "d"]  # a and b are too old, c is not
    assert count("false", 1061) == []
    rows = [(r["at"], r["documents"], r["hits"], r["misses"]) for r in files.use(spark, table).orderBy("at").collect()]
    assert rows == [(1000, 2, 0, 1), (1030, 3, 1, 1), (1060, 4, 1, 2), (1061, 0, 0, 0)]
    assert {r["at"]: r["hit_rate"] for r in files.use(spark, table).collect()}[1030] == 0.5
    assert files.expire(spark, table, 60, 1060) == 1 and files.expire(spark, table, 60, 1060) == 0
    assert count("true", 1061) == ["a", "b", "c", "d"] and files.expire(spark, table, 60, 5000) > 0 and count("doc = 'c'", 5000) == ["c"]


def test_registry(spark):
    """A language that is added while the program runs is detected, parsed, selected and rewritten."""
    from copse.functions import scalars
    from copse.providers import registry

    def items(text):  # a language of one statement: each line is an item
        from copse.providers.tree import Node

        kids, at = [], 0
        for line in text.split("\n"):
            if line:
                kids.append(Node("item", at, at + len(line)))
            at += len(line) + 1
        return Node("list", 0, len(text), kids)

    def names(node, text):
        from copse.providers.tree import Binding

        return [Binding(node, text[node.start : node.end])] if node.type == "item" else []

    registry.register(registry.Provider("items", items, names, {"entry": ("item",)}, (".items",), {"e": "entry"}))
    try:
        found = spark.createDataFrame([("a/x.ITEMS",), ("b.py",), ("c.ex",), ("d.html",)], "p string").select(scalars.language(F.col("p")).alias("l")).collect()
        assert [r.l for r in found] == ["items", "python", "elixir", "unknown"]
        docs = files.inline(spark, "items", a="one\ntwo\n").unionByName(files.inline(spark, "python", b="two = 1\n"))
        assert [(r.doc, r.kind, r.name) for r in files.select(docs, parse("entry:t*")).collect()] == [("a", "entry", "two")]
        assert [r.modified for r in files.transform(docs, "replace", parse("entry:two"), "2").collect()] == ["one\n2\n"]
    finally:
        registry.unregister("items")
    assert files.select(docs, parse("entry:t*")).count() == 0


def test_selections_parse_to_the_rows_they_read(spark, monkeypatch):
    """Nodes of types that a selector does not ask for have no rows; what it matches is what it matches among all rows."""
    docs = files.inline(spark, "python", a="def f():\n    return load('F')  # é\n\na, b = g(1), 2\n", b="class C:\n    def m(self):\n        if x:\n            load('F')\n", c="def f(:\n")
    whole, seen, write = files.parsed(docs).cache(), [], files.shared.written
    monkeypatch.setattr(files.shared, "written", lambda df, name: (seen.append((name, df)), write(df, name))[1])
    for selector in ("def:* > call:load arg0='F'", "var:b", "class:* >> def:m", "!call:g", "def:* | var:*", "call:* before=var:*", "module:*", "ERROR:*"):
        q = parse(selector)
        got = files.select(docs, q, ("python",)).select("doc", "kind", "name", "start_byte", "text", "depth", "ord").collect()
        assert sorted(got) == sorted(files.forest(whole, "python").select(q).select("doc", "kind", "name", "start_byte", "text", "depth", "ord").collect()), selector
        types = files.read_types(q, ("python",)).get("python")
        assert (types is None) == ("before" in selector)
        if types:
            some = files.parsed(docs, {"python": types})
            assert some.exceptAll(whole).isEmpty() and some.count() == whole.filter(F.col("node_type").isin(*types)).count() < whole.count()
    elements = next(df for name, df in seen if name == "elements")
    assert {r[0] for r in elements.select("node_type").distinct().collect()} == {"function_definition", "call"}
