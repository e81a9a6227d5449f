"""The operations by name, with JSON requests: query, replace, delete, insert_before, insert_after, append, file_query,
file_replace, file_delete, recipe and apply. Every result is a DataFrame; only what an answer needs is written.

A change to a single file is written at once, one to ``source`` text is only returned. With a session, changes are staged
instead (``staged``), and ``apply`` writes them. Stages and applies are tables that only grow: a stage's status comes from both.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse import jobs
from copse.functions import scalars
from copse.operators import ledger, recipe, rewrite, safety, score, sessions
from copse.plans.forest import projected
from copse.providers import registry
from copse.selector import Query, choose
from copse.sources import files, writer

TARGET = ("target", "target_dsl")
INPUT = ("language", "source", "path")
FIELDS = {
    "query": (*INPUT, "query", "dsl"), "replace": (*INPUT, *TARGET, "replacement"), "delete": (*INPUT, *TARGET), "insert_before": (*INPUT, *TARGET, "content"),
    "insert_after": (*INPUT, *TARGET, "content"), "append": (*INPUT, *TARGET, "content"), "file_query": ("scope", "query", "dsl"),
    "file_replace": ("scope", *TARGET, "replacement", "dry_run", "backup"), "file_delete": ("scope", *TARGET, "dry_run", "backup"),
    "recipe": ("name", "description", "dry_run", "min_confidence", "steps"), "apply": ("id", "all", "latest", "session"),
}
SCOPE = ("path", "include", "exclude", "max_depth", "max_files", "follow_symlinks", "language")
STAGES = """id string, session_id string, language string, operation string, target_type string, target_name string, target_query string, path string, original string, modified string, content string,
diff string, score double, level string, factors string, scope string, created_at timestamp, base_digest string, after_digest string, status string, expires_at timestamp"""
#: Stages that are deleted, by id.
DELETED = "id string, deleted_at timestamp"


class RequestError(ValueError):
    """A request that cannot be served."""


@dataclass(frozen=True)
class Rules:
    """Of staging: pending stages and applies of a session, at most (0: no limit), whether a stage whose score reaches the
    threshold is applied at once, and whether applying all of a session's stages stops at the first that fails or skips it."""

    max_pending: int = 0
    max_applies: int = 0
    auto_apply: bool = False
    threshold: float = score.AUTO_APPLY
    stop_at_first: bool = False


class Engine:
    """folder: where transactions and the ledger are kept (on a file system that executors share)."""

    def __init__(self, spark: SparkSession, folder: str, limits: safety.Limits = safety.Limits(), rules: Rules = Rules()) -> None:
        self.spark, self.folder, self.limits, self.rules = spark, os.path.abspath(folder), limits, rules
        self.works = jobs.Works(spark)

    def call(self, operation: str, request: dict) -> DataFrame:
        if operation not in FIELDS:
            raise RequestError(f"unknown operation {operation!r}")
        if extra := set(request) - set(FIELDS[operation]):
            raise RequestError(f"unknown fields: {', '.join(sorted(extra))}")
        if operation in rewrite.METHODS:
            return self.changed(operation, request)
        if operation in ("file_replace", "file_delete"):
            return self.file_changed(operation.removeprefix("file_"), request)
        return getattr(self, operation)(request)

    # what a request means
    def documents(self, request: dict) -> DataFrame:
        """The one document of a request: exactly one of source and path, and a language that has a parser."""
        source, path, language = request.get("source"), request.get("path"), request.get("language", "")
        if (source is None) == (path is None):
            raise RequestError("exactly one of source and path is needed")
        if registry.parser(language) is None:
            raise RequestError(f"unknown language {language!r}")
        if source is not None:
            return files.inline(self.spark, language, source=source)
        if not os.path.isfile(path):
            raise RequestError(f"{path} is no file")
        found = self.spark.read.format("binaryFile").load(f"file://{os.path.abspath(path)}")
        return found.select(F.lit(os.path.abspath(path)).alias("doc"), F.lit(language).alias("language"), scalars.utf8(F.col("content")).alias("source"))

    @staticmethod
    def scope(request: dict) -> files.Scope:
        given = request.get("scope") or {}
        if extra := set(given) - set(SCOPE):
            raise RequestError(f"unknown fields of scope: {', '.join(sorted(extra))}")
        return files.Scope(**{"path": ""} | {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}).checked()

    @staticmethod
    def target(request: dict, optional: bool = False) -> Query:
        if optional and not (request.get("target") or (request.get("target_dsl") or "").strip()):
            return Query()
        return choose(request.get("target_dsl"), request.get("target"))

    def languages(self, scope: files.Scope) -> tuple[str, ...]:
        if scope.language and scope.language not in registry.languages():
            raise RequestError(f"unknown language {scope.language!r}")
        return (scope.language,) if scope.language else registry.languages()

    # operations
    def query(self, request: dict) -> DataFrame:
        """Matches of one document; one with syntax errors is an error."""
        elements = files.parsed(self.documents(request))
        q = choose(request.get("dsl"), request.get("query"))
        if bad := files.rejects(elements).head():
            raise RequestError("; ".join(bad["errors"]))
        return projected(files.forest(elements, request["language"]).select(q)).orderBy("start_byte", "end_byte")

    def file_query(self, request: dict) -> DataFrame:
        """Matches in all files of a scope; files with errors give none."""
        scope = self.scope(request)
        return projected(files.select(files.walk(self.spark, scope), choose(request.get("dsl"), request.get("query")), self.languages(scope))).orderBy("doc", "start_byte", "end_byte")

    def changed(self, method: str, request: dict) -> DataFrame:
        """doc, modified, diff, confidence, match_count of one document; a file is written where it changes and is not blank
        then. No match gives no row."""
        made = self.rewritten(method, request)
        if request.get("path") is not None:
            made = self.kept(made)
            writing = made.filter((F.col("modified") != F.col("original")) & (F.trim("modified") != ""))
            writer.publish(self.spark, f"{self.folder}/transactions", writing, least=0.0)
        return rewrite.with_diff(made)

    def safe(self, made: DataFrame) -> None:
        """Each file that changes is a batch of its own, whose score is also the overall one."""
        each = made.filter("original <> modified").select(F.col("doc").alias("batch"), F.octet_length("original").cast("long").alias("size"), F.col("confidence.score").alias("confidence"))
        if row := safety.validate(each, self.limits).filter("code <> 0").orderBy("batch").head():
            raise RequestError(f"{row['batch']}: limit {row['code']} is exceeded")

    def rewritten(self, method: str, request: dict) -> DataFrame:
        target = self.target(request, method == "append")
        return files.transform(self.documents(request), method, target, request.get("replacement") or request.get("content") or "", (request["language"],))

    def kept(self, df: DataFrame) -> DataFrame:
        """Written once and read again: what is reported is what was there before files change."""
        path = f"{self.folder}/results/{datetime.now(timezone.utc).timestamp():.6f}"
        df.write.parquet(f"file://{path}")
        return self.spark.read.schema(df.schema).parquet(f"file://{path}")

    def file_changed(self, method: str, request: dict) -> DataFrame:
        """One row for each file with a match: doc, match_count, confidence, diff and status, and one for each that cannot be
        read, whose status is failed, with its error. Limits are checked before anything is written, first for the batch and
        then for each file with its own size and score; all files that were read are written or none."""
        scope = self.scope(request)
        docs = self.kept(files.walk(self.spark, scope))
        made = self.kept(files.transform(docs, method, self.target(request), request.get("replacement") or "", self.languages(scope)))
        sizes = files.listing(self.spark, scope).select(F.lit("all").alias("batch"), "size", F.lit(1.0).alias("confidence"))
        if (row := safety.validate(sizes, self.limits).head()) and row["code"]:
            raise RequestError(f"limit {row['code']} is exceeded")
        self.safe(made)
        status = writer.publish(self.spark, f"{self.folder}/transactions", made, request.get("backup") or False, dry_run=bool(request.get("dry_run")))
        one = status.select(F.col("doc").alias("d"), "status")
        out = rewrite.with_diff(made).join(one, F.col("doc") == F.col("d"), "left").drop("d", "original", "modified")
        out = out.withColumn("status", F.coalesce("status", F.lit("unchanged"))).withColumn("error", F.lit(None).cast("string"))
        failed = docs.filter("error is not null").select("doc", F.lit(0).cast("long").alias("match_count"), F.lit("failed").alias("status"), "error")
        return out.unionByName(failed, allowMissingColumns=True).orderBy("doc")

    def recipe(self, request: dict) -> DataFrame:
        """A row for each step that was run: totals and score. Steps are dry, unless ``dry_run`` is false; an error names the
        step whose confidence is too low, and what earlier steps have written stays."""
        spec = {"name": request.get("name"), "min_confidence": request.get("min_confidence"), "steps": [{**s, "dsl": s.get("dsl") or s.get("target_dsl")} for s in request.get("steps") or []]}
        steps, threshold = recipe.validated(spec)
        rows, apply = [], request.get("dry_run") is False
        for k, (step, given) in enumerate(zip(steps, request["steps"]), 1):
            scope = self.scope(given)
            docs = self.kept(files.walk(self.spark, scope))
            made = self.kept(files.transform(docs, step.method, step.target, step.payload, self.languages(scope)))
            scored = made.select((F.col("modified") != F.col("original")).alias("modified"), F.col("confidence.score").alias("score"), F.lit("").alias("error"), "match_count")
            scored = scored.unionByName(docs.filter("error is not null").select(F.lit(False).alias("modified"), F.lit(None).cast("double").alias("score"), "error", F.lit(0).cast("long").alias("match_count")))
            rolled = recipe.score.rollup(scored).head()
            matches = scored.agg(F.coalesce(F.sum("match_count"), F.lit(0))).head()[0]
            least = threshold if step.min_confidence is None else step.min_confidence
            if (rolled["files_modified"] or matches) and round(rolled["score"], 9) < least:
                raise recipe.RecipeError(f"step {step.name!r}: confidence {rolled['score']:.2f} is below {least:.2f}")
            if apply:
                writer.publish(self.spark, f"{self.folder}/transactions", made)
            rows.append((step.name, k, docs.count(), rolled["files_modified"], matches, rolled["score"], rolled["level"], apply))
        return self.spark.createDataFrame(rows, "step string, k int, scanned long, modified long, matches long, score double, level string, applied boolean")

    # the ledger
    def table(self, name: str, schema: str) -> DataFrame:
        where = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(f"file://{where}") if os.path.isdir(where) else self.spark.createDataFrame([], schema)

    def applies(self) -> DataFrame:
        """The table of applies, and those of committed transactions that it does not have yet: a transaction's folder says
        which stages it applies before any file is moved, so that a crash after the commit loses none."""
        done = self.table("applies", ledger.APPLIES)
        noted = [f"{t.place}/applies" for t in writer.transactions(self.spark, f"{self.folder}/transactions") if os.path.isdir(f"{t.place}/applies") and t.status() == "committed"]
        if not noted:
            return done
        return done.unionByName(self.spark.read.schema(ledger.APPLIES).parquet(*[f"file://{x}" for x in noted])).dropDuplicates(["id"])

    def stages(self, now: datetime | None = None) -> DataFrame:
        """All stages that are not deleted, with their status at ``now``."""
        have = self.table("stages", STAGES).join(self.table("deleted", DELETED).select("id").distinct(), "id", "left_anti")
        return ledger.expire(ledger.mark_applied(have, self.applies()), F.lit(now or datetime.now(timezone.utc)))

    def delete_stages(self, session: str | None = None, ids: list[str] | None = None) -> None:
        """Deletes a session's applied stages, or those ids."""
        have = self.stages()
        gone = have.join(ledger.delete(have, session, ids).select("id"), "id", "left_anti")
        gone.select("id", F.lit(datetime.now(timezone.utc)).alias("deleted_at")).write.mode("append").parquet(f"file://{self.folder}/deleted")

    def staged(self, session: str, operation: str, request: dict, max_pending: int | None = None) -> DataFrame:
        """Stages a change of one document: the rows that were added (none beyond the session's limit of pending ones), with
        ``outcome``: applied where the rules say so and the apply succeeds, else staged. A source's stage is applied without
        a file."""
        began, limit = time.perf_counter(), self.rules.max_pending if max_pending is None else max_pending
        target = self.target(request, operation == "append")
        made = rewrite.with_diff(self.rewritten(operation, request).filter(F.col("modified") != F.col("original")))
        now, path = datetime.now(timezone.utc), request.get("path")
        scope = F.to_json(F.struct(F.col("doc").alias("file_path"), F.lit(True).alias("safety_validated"), F.octet_length("modified").alias("file_size"), ledger.digest(F.col("original")).alias("original_hash")))
        rows = made.select(
            F.concat(F.lit("stg_"), F.substring(F.sha2(F.concat_ws("\0", F.lit(session), "doc", "modified", F.lit(str(now))), 256), 1, 16)).alias("id"), F.lit(session).alias("session_id"),
            F.lit(request["language"]).alias("language"), F.lit(operation).alias("operation"), F.lit(target.kind or "").alias("target_type"), F.lit(target.name or "").alias("target_name"),
            F.lit(json.dumps(target.to_json())).alias("target_query"), F.when(F.lit(path is not None), F.col("doc")).alias("path"), "original", "modified",
            F.lit(request.get("replacement") or request.get("content") or "").alias("content"), "diff", F.col("confidence.score").alias("score"), F.col("confidence.level").alias("level"),
            F.to_json("confidence.factors").alias("factors"), F.when(F.lit(path is not None), scope).alias("scope"), F.lit(now).alias("created_at"))
        new = self.kept(ledger.admit(ledger.build(rows), limit, self.stages(now)).filter("admitted").drop("admitted"))
        columns = self.spark.createDataFrame([], STAGES).columns
        new.select(columns).write.mode("append").parquet(f"file://{self.folder}/stages")
        wanted = ledger.finalize(new, self.rules.auto_apply, self.rules.threshold)
        done = []
        for r in wanted.filter("outcome = 'applied'").select("id").collect():  # a request changes one document
            try:
                done += [x["id"] for x in self.apply({"id": r["id"]}, auto=True).filter("outcome = 'ok'").collect()]
            except (writer.TransactionError, RequestError):
                continue  # it stays staged
        self.spark.createDataFrame([(time.perf_counter() - began, True)], "seconds double, ok boolean").write.mode("append").parquet(f"file://{self.folder}/created")
        return new.withColumn("outcome", F.when(F.col("id").isin(done), "applied").otherwise("staged"))

    def metrics(self) -> DataFrame:
        """Of all creations of stages: counts, mean and largest time."""
        return ledger.metrics(self.table("created", "seconds double, ok boolean"))

    def apply(self, request: dict, auto: bool = False) -> DataFrame:
        """id, outcome of the stages that a request means: one by id, all pending ones, or the latest (the default). Only
        stages that are pending, in time, within their session's limit of applies and whose file has not changed are
        written; several in one transaction."""
        now = datetime.now(timezone.utc)
        have = self.stages(now)
        if request.get("session"):
            have = have.filter(F.col("session_id") == request["session"])
        if request.get("id"):
            have = have.filter(F.col("id") == request["id"])
            if not have.head():
                raise RequestError(f"no stage {request['id']}")
        elif request.get("all"):
            have = have.filter("status = 'pending'")
        else:
            have = have.filter("status = 'pending'").orderBy(F.desc("created_at"), F.desc("id")).limit(1)
        chosen = self.kept(have)
        out = ledger.outcomes(chosen, F.lit(now), self.hashes(chosen))
        within = ledger.within_limit(out.filter("outcome = 'ok'"), self.applies_with_sessions(), self.rules.max_applies).select("id", F.lit(True).alias("within"))
        out = out.join(within, "id", "left").withColumn("outcome", F.when((F.col("outcome") == "ok") & F.col("within").isNull(), "limit").otherwise(F.col("outcome"))).drop("within")
        out = self.kept(ledger.attempted(out, bool(request.get("all")) and self.rules.stop_at_first))
        good = out.filter("outcome = 'ok'")
        if good.head():
            rows = ledger.applies_of(good, F.lit(now), auto, "auto" if auto else "engine")
            tx = writer.begin(self.spark, f"{self.folder}/transactions")
            rows.write.parquet(f"file://{tx.place}/applies")  # counts once the transaction is committed
            writer.stage(tx, good.filter("path is not null").select("path", "original", "modified"))
            writer.commit(tx)
            rows.write.mode("append").parquet(f"file://{self.folder}/applies")
        return out.select("id", "outcome")

    def sessions(self) -> DataFrame:
        """One row for each session: times and counters. They are counted from the stages and applies that there are, and so
        are right whatever failed in between."""
        staged = self.table("stages", STAGES).dropDuplicates(["id"]).select("session_id", F.lit("stage").alias("kind"), F.col("created_at").alias("at"))
        applied = self.applies_with_sessions().select("session_id", F.lit("apply").alias("kind"), F.col("applied_at").alias("at"))
        return sessions.counted(staged.unionByName(applied).withColumn("client", F.lit(None).cast("string"))).drop("client", "client_at")

    def submit(self, operation: str, request: dict, token: str | None = None, timeout: float | None = None) -> jobs.Work:
        """``call`` in the background, under a token by which it can be followed and cancelled, for at most ``timeout`` seconds
        (those of ``jobs.LIMITS`` if not given). Its result is a written table."""
        limit = jobs.LIMITS.get(operation) if timeout is None else timeout
        return self.works.submit(lambda: self.kept(self.call(operation, request)), token, limit)

    def applies_with_sessions(self) -> DataFrame:
        sessions = self.table("stages", STAGES).select(F.col("id").alias("stage_id"), "session_id")
        return self.applies().join(sessions, "stage_id")

    def hashes(self, stages: DataFrame) -> DataFrame:
        """id and hash of each stage's file as it is now ('' if there is none); stages of sources have no row."""
        paths = [r["path"] for r in stages.select("path").distinct().filter("path is not null").collect()]
        there = [f"file://{x}" for x in paths if os.path.isfile(x)]
        named = stages.filter("path is not null").select("id", "path")
        if not there:
            return named.select("id", F.lit("").alias("hash"))
        read = self.spark.read.format("binaryFile").load(there)
        found = read.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("p"), F.sha2("content", 256).alias("hash"))
        return named.join(found, F.col("path") == F.col("p"), "left").select("id", F.coalesce("hash", F.lit("")).alias("hash"))
