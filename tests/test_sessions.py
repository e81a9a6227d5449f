"""Sessions, what applying all comes to, lookups by id, changes of folders, and work under tokens."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from copse import jobs
from copse.operators import ledger
from copse.operators.sessions import Sessions
from copse.sources import files
from copse.streaming import changes

EVENTS = "session_id string, kind string, at timestamp, client string"


def events(spark, rows):
    return spark.createDataFrame(rows, "session_id string, kind string, at double, client string").withColumn("at", F.timestamp_seconds("at"))


def test_sessions_of_repeated_and_reordered_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), rng.choice(["stage", "apply", "end", "other"]), float(rng.randint(0, 50)), rng.choice([None, "x", "y"])) for _ in range(300)]
    batches = [rows[i::5] for i in range(5)]
    kept = Sessions(spark, f"file://{tmp_path}/sessions")
    assert kept.table().count() == 0 and kept.compact() == 0
    for k in (3, 1, 3, 0):
        assert kept.merge(k, events(spark, batches[k]))
    assert kept.compact() == 3 and not kept.merge(1, events(spark, batches[1]))
    for k in (4, 2, 4):
        kept.merge(k, events(spark, batches[k]))
    for _ in range(2):
        got = {r.session_id: r for r in kept.table().collect()}
        assert got.keys() == {"a", "b", None, ""}
        for s, r in got.items():
            own = [x for x in rows if x[0] == s]
            assert (r.stages_count, r.applies_count) == tuple(sum(x[1] == k for x in own) for k in ("stage", "apply"))
            assert (r.started_at.timestamp(), r.last_at.timestamp()) == (min(x[2] for x in own), max(x[2] for x in own))
            assert r.ended_at.timestamp() == max(x[2] for x in own if x[1] == "end")
            assert r.client == max((x[2], x[3]) for x in own if x[3])[1]
        assert kept.compact() == 5
    with pytest.raises(ValueError):
        kept.merge("../x", events(spark, rows))


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    kept = Sessions(spark, f"file://{tmp_path}/sessions")
    kept.merge("one", events(spark, [("a", "stage", 1.0, None)]))
    broken = events(spark, [("a", "stage", 2.0, None)]).withColumn("client", F.raise_error("lost").cast("string"))
    with pytest.raises(Exception, match="lost"):
        kept.merge("two", broken)
    assert [r.stages_count for r in kept.table().collect()] == [1]
    # the same batch with other events: the last writer wins
    kept.merge("one", events(spark, [("a", "stage", 1.0, None), ("b", "apply", 5.0, "c")]))
    assert sorted((r.session_id, r.stages_count, r.applies_count) for r in kept.table().collect()) == [("a", 1, 0), ("b", 0, 1)]


def test_sessions_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    events(spark, [("a", "stage", 1.0, None), ("a", "apply", 2.0, "c")]).write.parquet(str(source))
    kept = Sessions(spark, f"file://{tmp_path}/sessions")
    for _ in range(2):  # the second run finds nothing new
        spark.readStream.schema(EVENTS).parquet(str(source)).writeStream.foreachBatch(kept.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.stages_count, r.applies_count, r.client) for r in kept.table().collect()] == [(1, 1, "c")]


def test_apply_all_modes(spark):
    rows = [("s", "a", 1, "ok"), ("s", "b", 2, "expired"), ("s", "c", 2, "ok"), ("s", "d", 3, "changed"), ("t", "e", 9, "ok"), (None, "f", 1, "changed"), (None, "g", 1, "ok"), ("u", "h", 1, "not_pending")]
    df = spark.createDataFrame(rows, "session_id string, id string, created_at long, outcome string")
    skip = {r.id: r.outcome for r in ledger.attempted(df, stop=False).collect()}
    stop = {r.id: r.outcome for r in ledger.attempted(df, stop=True).collect()}
    assert skip == {i: o for _, i, _, o in rows}
    assert stop == skip | {"c": "not_attempted", "d": "not_attempted", "g": "not_attempted"}


def test_lookup_reads_one_bucket(spark, tmp_path):
    stages = spark.range(2000).select(F.concat(F.lit("stg_"), "id").alias("id"), F.lit("s").alias("session_id"))
    where = str(tmp_path / "stages")
    ledger.save(stages, where, 64)
    ledger.save(spark.createDataFrame([("stg_new", "s")], "id string, session_id string"), where, 64)
    found = ledger.lookup(spark.read.parquet(where), ["stg_77"], 64)
    folders = {os.path.dirname(x) for x in found.inputFiles()}
    assert [r.id for r in found.collect()] == ["stg_77"]
    read = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "bucket" in read and len(folders) <= 64
    selected = spark.read.parquet(where).filter("bucket = 5").select("_metadata.file_path").distinct().count()
    assert selected == 1 and ledger.lookup(spark.read.parquet(where), ["stg_new", "stg_3", "none"], 64).count() == 2 and ledger.lookup(spark.read.parquet(where), [], 64).count() == 0


def test_compared(spark):
    schema = "uri string, mark string"
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1"), ("d", "0"), (None, "x")], schema)
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1"), ("e", None)], schema)
    found = lambda x, y: sorted((r.uri or "", r.type) for r in changes.compared(x, y).collect())
    assert found(before, after) == [("", "list_changed"), ("b", "updated"), ("e", "updated")]
    assert found(after, before) == [("", "list_changed"), ("b", "updated"), ("e", "removed")]
    assert found(before, before) == [] and found(before.limit(0), before.limit(0)) == []
    assert found(before.filter("uri = 'b'"), after.filter("uri = 'b'")) == [("b", "updated")]


@pytest.mark.parametrize("by_content", [False, True])
def test_feed(spark, tmp_path, by_content):
    """Each change is told once, also by a feed that starts anew."""
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.go").write_text("a")
    (src / "b.go").write_text("b")
    (src / "other.txt").write_text("t")
    feed = lambda: changes.Feed(spark, files.Scope(str(src), include=("*.go",)), f"file://{tmp_path}/state", by_content)
    seen = lambda n: sorted((os.path.basename(r.uri or ""), r.type) for r in feed().events(n).collect())
    assert feed().last() == 0 and feed().poll() == 1 and seen(1) == [] and feed().poll() == 1
    (src / "a.go").write_text("aa")
    (src / "c.go").write_text("c")
    (src / "b.go").unlink()
    (src / "more.txt").write_text("t")
    assert feed().poll() == 2 and seen(2) == [("", "list_changed"), ("a.go", "updated"), ("b.go", "removed"), ("c.go", "updated")]
    assert feed().poll() == 2  # nothing new after a restart
    (src / "a.go").write_text("aaa")
    assert feed().poll() == 3 and seen(3) == [("a.go", "updated")]


def test_followed_feed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.go").write_text("a")
    feed, calls, failed = changes.Feed(spark, files.Scope(str(src)), f"file://{tmp_path}/state"), [], []
    feed.poll()

    def handle(found, number):
        calls.append((number, sorted(r.type for r in found.collect())))

    query = feed.follow(handle, f"{tmp_path}/cp", 0.2)
    (src / "b.go").write_text("b")
    end = time.time() + 60
    while not calls and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert calls == [(2, ["list_changed", "updated"])] and not failed
    (src / "b.go").unlink()
    query = feed.follow(handle, f"{tmp_path}/cp", 0.2)  # a restart: what was told is not told again
    end = time.time() + 60
    while len(calls) < 2 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert calls[1:] == [(3, ["list_changed", "removed"])]


def sleeping(spark):
    def run(frames):
        for f in frames:
            time.sleep(40)
            yield f

    return lambda: spark.range(2, numPartitions=2).mapInPandas(run, "id long").count()


def test_work_is_cancelled_and_others_go_on(spark):
    works = jobs.Works(spark)
    work = works.submit(sleeping(spark), token="long")
    end = time.time() + 60
    while work.progress().first().active == 0 and time.time() < end:
        time.sleep(0.1)
    with pytest.raises(ValueError):
        works.submit(lambda: None, token="long")
    other = works.submit(lambda: spark.range(10).count(), token="other")
    began = time.time()
    assert works.cancel("long") and time.time() - began < 30 and not works.cancel("long") and not works.cancel("none")
    with pytest.raises(jobs.Cancelled):
        work.result()
    assert other.result(60) == 10 and spark.range(5).count() == 5
    rows = {r.token: r for r in works.progress().collect()}
    assert rows["long"].state == "cancelled" and rows["other"].state == "done" and rows["other"].completed == rows["other"].tasks > 0
    assert works.submit(lambda: 7, token="long").result(60) == 7


def test_work_that_spark_cannot_end(spark, monkeypatch):
    monkeypatch.setattr(jobs, "GRACE", 0.5)
    work = jobs.Work(spark, threading.Event().wait, timeout=0.2).start()
    with pytest.raises(jobs.TimedOut):
        work.result(30)
    assert work.progress().first().state == "timed_out"


def test_work_has_limits(spark):
    work = jobs.Work(spark, sleeping(spark), timeout=1.0).start()
    with pytest.raises(jobs.TimedOut):
        work.result(60)
    failing = jobs.Work(spark, lambda: spark.range(1).select(F.raise_error("bad")).collect()).start()
    with pytest.raises(Exception, match="bad"):
        failing.result(60)
    assert failing.state == "failed" and not failing.cancel()
    with pytest.raises(TimeoutError):
        jobs.Work(spark, threading.Event().wait).start().result(0.1)


def test_engine_in_the_background(spark, tmp_path):
    from copse.engine import Engine, Rules

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.go").write_text("package main\n\nfunc A() {}\n")
    (tmp_path / "src" / "b.go").write_text("package main\n\nfunc B() {}\n")
    e = Engine(spark, str(tmp_path / "state"), rules=Rules(stop_at_first=True))
    found = e.submit("file_query", {"scope": {"path": str(tmp_path / "src")}, "dsl": "func:*"}, token="q").result(120)
    assert [r["name"] for r in found.collect()] == ["A", "B"]
    change = lambda x: {"language": "go", "path": str(tmp_path / "src" / f"{x.lower()}.go"), "target_dsl": f"func:{x}", "replacement": f"func {x}2() {{}}"}
    a, b = (e.staged("s", "replace", change(x)).first()["id"] for x in "AB")
    (tmp_path / "src" / "a.go").write_text("package other\n")
    assert {r["id"]: r["outcome"] for r in e.call("apply", {"all": True, "session": "s"}).collect()} == {a: "changed", b: "not_attempted"}
    skipping = Engine(spark, str(tmp_path / "state"))
    assert {r["id"]: r["outcome"] for r in skipping.call("apply", {"all": True, "session": "s"}).collect()} == {a: "changed", b: "ok"}
    assert [(r.session_id, r.stages_count, r.applies_count) for r in e.sessions().collect()] == [("s", 2, 1)]
