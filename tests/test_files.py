"""Transactions over files, and streams."""

import os
import stat

import pytest
from pyspark.sql import functions as F

from copse.selector import parse
from copse.sources import files, writer
from copse.streaming import ingest


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name, text in {"a.py": "def old():\n    pass\n", "b.py": "x = 1\n", "c.py": "def old():\n    return 2\n"}.items():
        (src / name).write_text(text)
    os.chmod(src / "a.py", 0o640)
    return tmp_path


def details(spark, tree, payload="def new():\n    pass"):
    e = files.parsed(files.walk(spark, files.Scope(str(tree / "src"))))
    return files.transform(e, "replace", parse("def:old"), payload, ("python",))


def test_publish(spark, tree):
    dry = writer.publish(spark, str(tree / "tx"), details(spark, tree), dry_run=True)
    assert {r["status"] for r in dry.collect()} == {"dry_run"} and "old" in (tree / "src/a.py").read_text()
    done = writer.publish(spark, str(tree / "tx"), details(spark, tree), backup=True).collect()
    assert {os.path.basename(r["doc"]) for r in done} == {"a.py", "c.py", "a.py.bak", "c.py.bak"}
    assert (tree / "src/a.py").read_text() == "def new():\n    pass\n" and (tree / "src/a.py.bak").read_text() == "def old():\n    pass\n"
    assert stat.S_IMODE(os.stat(tree / "src/a.py").st_mode) == 0o640
    assert (tree / "src/b.py").read_text() == "x = 1\n"
    assert not [p for p in (tree / "src").iterdir() if p.name.endswith(".tmp")]


def test_low_confidence(spark, tree):
    low = details(spark, tree, "def (").withColumn("confidence", F.struct(F.lit(0.2).alias("score")))
    with pytest.raises(writer.TransactionError, match="confidence"):
        writer.publish(spark, str(tree / "tx"), low)
    assert "old" in (tree / "src/a.py").read_text() and not writer.transactions(spark, str(tree / "tx"))


def changes(spark, tree, **texts):
    rows = [(str(tree / "src" / k.replace("_", ".")), *v) for k, v in texts.items()]
    return spark.createDataFrame(rows, "path string, original string, modified string")


def test_commit_and_rollback(spark, tree):
    tx = writer.begin(spark, str(tree / "tx"))
    log = writer.stage(tx, changes(spark, tree, a_py=("def old():\n    pass\n", "A\n"), b_py=("x = 1\n", None), d_py=(None, "D\n"), c_py=("same", "same")))
    assert log.count() == 3 and [t.id for t in writer.pending(spark, tx.folder)] == [tx.id]
    assert {r["status"]: r["n"] for r in writer.summary(writer.commit(tx)).collect()} == {"committed": 3}
    assert (tree / "src/a.py").read_text() == "A\n" and not (tree / "src/b.py").exists() and (tree / "src/d.py").read_text() == "D\n"
    with pytest.raises(writer.TransactionError):
        writer.commit(tx)
    writer.rollback(tx)
    assert (tree / "src/a.py").read_text() == "def old():\n    pass\n" and (tree / "src/b.py").read_text() == "x = 1\n" and not (tree / "src/d.py").exists()
    assert tx.status() == "rolled_back" and writer.cleanup(spark, tx.folder, 0) == 1 and not writer.transactions(spark, tx.folder)


def test_changed_since(spark, tree):
    tx = writer.begin(spark, str(tree / "tx"))
    writer.stage(tx, changes(spark, tree, a_py=("def old():\n    pass\n", "A\n"), b_py=("x = 2\n", "y\n")))
    with pytest.raises(writer.TransactionError, match="changed since"):
        writer.commit(tx)
    assert tx.status() == "failed" and "old" in (tree / "src/a.py").read_text()


def test_failed_write_is_undone(spark, tree):
    (tree / "src/folder").write_text("a file, so nothing can be below it")
    tx = writer.begin(spark, str(tree / "tx"))
    blocked = spark.createDataFrame([(str(tree / "src/folder/x"), None, "X")], "path string, original string, modified string")
    writer.stage(tx, changes(spark, tree, a_py=("def old():\n    pass\n", "A\n")).unionByName(blocked))
    with pytest.raises(writer.TransactionError, match="rolled back"):
        writer.commit(tx)
    assert "old" in (tree / "src/a.py").read_text() and tx.status() == "rolled_back"


def test_twice(spark, tree):
    tx = writer.begin(spark, str(tree / "tx"))
    two = changes(spark, tree, a_py=("def old():\n    pass\n", "A\n"))
    with pytest.raises(writer.TransactionError, match="twice"):
        writer.stage(tx, two.unionByName(two.withColumn("modified", F.lit("B"))))


def test_incoming(spark, tree):
    scope = files.Scope(str(tree / "src"), include=("*.py",))
    q = ingest.select_into(spark, scope, parse("def:*"), str(tree / "out"), str(tree / "cp"))
    q.awaitTermination(120)
    (tree / "src/e.py").write_text("def late(): pass\n")
    q = ingest.select_into(spark, scope, parse("def:*"), str(tree / "out"), str(tree / "cp"))
    q.awaitTermination(120)
    assert sorted(r["name"] for r in spark.read.parquet(str(tree / "out")).select("name").collect()) == ["late", "old", "old"]


def test_watch(spark, tree):
    seen = []
    q = ingest.watch(spark, files.Scope(str(tree / "src")), str(tree / "cp"), lambda df, _: seen.extend(df.collect()), availableNow=True)
    q.awaitTermination(120)
    assert {(os.path.basename(r["uri"]), r["type"]) for r in seen} == {("a.py", "updated"), ("b.py", "updated"), ("c.py", "updated")}


def test_expiry(spark, tree):
    """Batches of events: s1 is applied in time, s2 expires when time has passed, s3's apply comes too late, s4 has none."""
    where = tree / "events"
    batches = [
        [("s1", "stage", "2024-01-01 00:00:00"), ("s2", "stage", "2024-01-01 00:01:00"), ("s3", "stage", "2024-01-01 00:02:00")],
        [("s1", "apply", "2024-01-01 00:05:00"), ("s4", "apply", "2024-01-01 00:05:00"), ("s3", "apply", "2024-01-01 00:30:00")],
        [("s5", "stage", "2024-01-01 02:00:00")], [("s6", "stage", "2024-01-01 03:00:00")],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, b in enumerate(batches):
            spark.createDataFrame(b, "id string, kind string, ts string").select("id", "kind", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(str(where))
            events = spark.readStream.schema("id string, kind string, ts timestamp").parquet(str(where))
            q = ingest.expiring(events).writeStream.format("parquet").option("path", str(tree / "status")).option("checkpointLocation", str(tree / "cp")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["id"], r["status"], str(r["at"])[11:16]) for r in spark.read.parquet(str(tree / "status")).collect()}
    assert got >= {("s1", "pending", "00:00"), ("s1", "applied", "00:05"), ("s2", "expired", "00:16"), ("s3", "expired", "00:17"), ("s4", "refused", "00:05")}
    assert ("s1", "expired", "00:15") not in got and not {x for x in got if x[0] == "s2" and x[1] == "applied"}
