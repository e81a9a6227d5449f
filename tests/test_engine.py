"""Operations by name, end to end on files."""

import pytest

from copse.engine import Engine, RequestError, Rules
from copse.operators.recipe import RecipeError
from copse.operators.safety import Limits
from copse.sources import writer

GO = "package main\n\nimport \"os\"\n\nfunc LegacyA() string {\n\treturn os.Getenv(\"X\")\n}\n\nfunc keep() int {\n\treturn 1\n}\n"


@pytest.fixture
def engine(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.go").write_text(GO)
    (src / "b.go").write_text("package main\n\nfunc LegacyB() {}\n")
    (src / "bad.go").write_text("package main\nfunc f( {\n")
    (src / "c.py").write_text("def legacy(): pass\n")
    e = Engine(spark, str(tmp_path / "state"))
    e.src = src
    return e


def test_query(engine):
    r = engine.call("query", {"language": "go", "source": GO, "dsl": "func:* > call:os.Getenv"}).collect()
    assert [(x["type"], x["name"], x["line"], x["column"]) for x in r] == [("function", "LegacyA", 5, 1)]
    same = engine.call("query", {"language": "go", "path": str(engine.src / "a.go"), "query": {"type": "func", "contains": {"type": "call", "name": "os.Getenv"}}}).collect()
    assert [x["content"] for x in same] == [x["content"] for x in r]
    found = engine.call("file_query", {"scope": {"path": str(engine.src)}, "dsl": "func:*"}).collect()
    assert [x["name"] for x in found] == ["LegacyA", "keep", "LegacyB", "legacy"]


@pytest.mark.parametrize(("operation", "request_"), [
    ("query", {"language": "go", "dsl": "func:*"}), ("query", {"language": "go", "source": "", "path": "x", "dsl": "func:*"}), ("query", {"language": "cobol", "source": "", "dsl": "func:*"}),
    ("query", {"language": "go", "source": "", "dsl": "func:*", "more": 1}), ("query", {"language": "go", "source": "package a\nfunc f( {", "dsl": "func:*"}), ("sort", {}),
    ("query", {"language": "go", "source": ""}), ("query", {"language": "go", "path": "/none", "dsl": "func:*"}), ("file_query", {"scope": {"path": "/none"}, "dsl": "func:*"}), ("apply", {"id": "stg_none"}),
])
def test_bad_requests(engine, operation, request_):
    with pytest.raises(ValueError):
        engine.call(operation, request_)


def test_single_file(engine):
    path = str(engine.src / "a.go")
    text = engine.call("replace", {"language": "go", "source": GO, "target_dsl": "func:LegacyA", "replacement": "func New() {}"}).first()
    assert "func New() {}" in text["modified"] and "+func New" in text["diff"] and (engine.src / "a.go").read_text() == GO
    done = engine.call("delete", {"language": "go", "path": path, "target_dsl": "func:keep"}).first()
    assert done["match_count"] == 1 and "keep" not in (engine.src / "a.go").read_text()
    engine.call("append", {"language": "go", "path": path, "content": "func tail() {}"})
    assert (engine.src / "a.go").read_text().count("func tail() {}") == 1
    assert engine.call("replace", {"language": "go", "path": path, "target_dsl": "func:none", "replacement": "x"}).count() == 0


def test_files(engine, spark):
    request = {"scope": {"path": str(engine.src), "include": ["**/*.go"]}, "target_dsl": "func:Legacy*", "replacement": "func Fresh() {}"}
    dry = engine.call("file_replace", request | {"dry_run": True}).collect()
    assert [(r["match_count"], r["status"]) for r in dry] == [(1, "dry_run")] * 2 and "LegacyB" in (engine.src / "b.go").read_text()
    done = engine.call("file_replace", request | {"backup": True}).collect()
    assert {r["status"] for r in done} == {"committed"} and "Fresh" in (engine.src / "a.go").read_text() and "LegacyB" in (engine.src / "b.go.bak").read_text()
    small = Engine(spark, engine.folder, Limits(max_files=1))
    with pytest.raises(RequestError, match="11002"):
        small.call("file_delete", {"scope": {"path": str(engine.src)}, "target_dsl": "func:Fresh"})


def test_recipe(engine):
    step = {"name": "drop", "method": "replace", "scope": {"path": str(engine.src), "include": ["*.py"], "language": "python"}, "target_dsl": "def:legacy", "replacement": "def current(): pass"}
    dry = engine.call("recipe", {"name": "r", "steps": [step], "min_confidence": 0.5}).collect()
    assert [(r["scanned"], r["modified"], r["matches"], r["applied"]) for r in dry] == [(1, 1, 1, False)] and "legacy" in (engine.src / "c.py").read_text()
    with pytest.raises(RecipeError, match="confidence"):
        engine.call("recipe", {"name": "r", "steps": [step], "min_confidence": 0.99, "dry_run": False})
    engine.call("recipe", {"name": "r", "steps": [step], "min_confidence": 0.5, "dry_run": False})
    assert (engine.src / "c.py").read_text() == "def current(): pass\n"
    with pytest.raises(RecipeError, match="unsupported method"):
        engine.call("recipe", {"name": "r", "steps": [step | {"method": "rewrite"}]})


def test_ledger(engine):
    request = {"language": "go", "path": str(engine.src / "b.go"), "target_dsl": "func:LegacyB", "replacement": "func NewB() {}"}
    first = engine.staged("s", "replace", request, max_pending=2).first()
    second = engine.staged("s", "replace", request | {"replacement": "func Other() {}"}, max_pending=2).first()
    assert engine.staged("s", "replace", request, max_pending=2).count() == 0 and "LegacyB" in (engine.src / "b.go").read_text()
    assert [tuple(r) for r in engine.call("apply", {"session": "s"}).collect()] == [(second["id"], "ok")]
    assert "Other" in (engine.src / "b.go").read_text()
    assert [tuple(r) for r in engine.call("apply", {"id": first["id"]}).collect()] == [(first["id"], "changed")]
    assert [tuple(r) for r in engine.call("apply", {"id": second["id"]}).collect()] == [(second["id"], "not_pending")]
    assert {r["id"]: r["status"] for r in engine.stages().collect()} == {first["id"]: "pending", second["id"]: "applied"}


def test_limits_by_file(engine, spark):
    """A score that the batch's check does not see fails the file's own."""
    request = {"scope": {"path": str(engine.src), "include": ["**/*.go"]}, "target_dsl": "func:Legacy*", "replacement": "func Fresh() {}"}
    strict = Engine(spark, engine.folder, Limits(per_file=0.99))
    with pytest.raises(RequestError, match="a.go: limit 11004"):
        strict.call("file_replace", request)
    assert "LegacyA" in (engine.src / "a.go").read_text()
    assert Engine(spark, engine.folder, Limits(per_file=0.1, mode="both", overall=0.1)).call("file_replace", request).count() == 2


def test_auto_apply_and_limits(engine, spark):
    request = {"language": "go", "path": str(engine.src / "b.go"), "target_dsl": "func:LegacyB", "replacement": "func NewB() {}"}
    auto = Engine(spark, engine.folder, rules=Rules(auto_apply=True, threshold=0.5, max_applies=1))
    row = auto.staged("s", "replace", request).first()
    assert row["outcome"] == "applied" and "NewB" in (engine.src / "b.go").read_text()
    assert (row["language"], row["target_type"], row["target_name"], row["content"]) == ("go", "func", "LegacyB", "func NewB() {}")
    assert "+func NewB" in row["diff"] and row["level"] in ("low", "medium", "high") and "exported_api" in row["factors"] and '"file_size"' in row["scope"]
    more = auto.staged("s", "replace", request | {"target_dsl": "func:NewB", "replacement": "func C() {}"}).first()
    assert more["outcome"] == "staged" and [r["outcome"] for r in auto.call("apply", {"id": more["id"]}).collect()] == ["limit"]
    assert "NewB" in (engine.src / "b.go").read_text()
    source = auto.staged("other", "replace", {"language": "go", "source": GO, "target_dsl": "func:keep", "replacement": "func kept() {}"}).first()
    assert source["outcome"] == "applied" and source["path"] is None
    low = Engine(spark, engine.folder, rules=Rules(auto_apply=True, threshold=0.999)).staged("third", "delete", {"language": "go", "path": str(engine.src / "b.go"), "target_dsl": "func:NewB"}).first()
    assert low["outcome"] == "staged"
    applied = {r["id"]: (r["auto_applied"], r["applied_by"]) for r in auto.applies().withColumnRenamed("id", "a").withColumnRenamed("stage_id", "id").collect()}
    assert applied == {row["id"]: (True, "auto"), source["id"]: (True, "auto")}
    assert tuple(auto.metrics().first())[:3] == (4, 4, 0)
    auto.delete_stages("s")
    assert {r["id"] for r in auto.stages().collect()} == {more["id"], source["id"], low["id"]}
    auto.delete_stages(ids=[low["id"]])
    assert {r["id"] for r in auto.stages().collect()} == {more["id"], source["id"]}


def test_apply_after_a_crash(engine, spark, monkeypatch):
    """Files are committed and the ledger is not written: the transaction still tells which stages it applied."""
    request = {"language": "go", "path": str(engine.src / "b.go"), "target_dsl": "func:LegacyB", "replacement": "func NewB() {}"}
    row = engine.staged("s", "replace", request).first()
    commit = writer.commit

    def crash(tx):
        commit(tx)
        raise KeyboardInterrupt

    monkeypatch.setattr(writer, "commit", crash)
    with pytest.raises(KeyboardInterrupt):
        engine.call("apply", {"id": row["id"]})
    assert "NewB" in (engine.src / "b.go").read_text() and [r["status"] for r in engine.stages().collect()] == ["applied"]


def test_a_file_that_cannot_be_read(engine, monkeypatch):
    """It is reported and costs 0.2 of a recipe's score; the others are changed."""
    from pyspark.sql import functions as F

    from copse.sources import files

    walk = files.walk

    def broken(spark, scope):
        lost = F.col("path") == "b.go"
        return walk(spark, scope).withColumn("error", F.when(lost, "lost")).withColumn("source", F.when(~lost, F.col("source")))

    request = {"scope": {"path": str(engine.src), "include": ["**/*.go"]}, "target_dsl": "func:Legacy*", "replacement": "func Fresh() {}"}
    step = {"name": "s", "method": "replace", **request}
    before = engine.call("recipe", {"name": "r", "steps": [step], "min_confidence": 0.1}).first()
    monkeypatch.setattr(files, "walk", broken)
    after = engine.call("recipe", {"name": "r", "steps": [step], "min_confidence": 0.1}).first()
    assert (before["modified"], after["modified"], after["scanned"]) == (2, 1, 3) and before["score"] - after["score"] > 0.15
    rows = {r["doc"].rsplit("/", 1)[1]: r for r in engine.call("file_replace", request).collect()}
    assert (rows["b.go"]["status"], rows["b.go"]["error"]) == ("failed", "lost") and rows["a.go"]["status"] == "committed" and rows["a.go"]["error"] is None
    assert "Fresh" in (engine.src / "a.go").read_text() and "LegacyB" in (engine.src / "b.go").read_text()
