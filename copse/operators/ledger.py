"""The ledger of staged changes: tables of stages and applies, and functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TTL_MINUTES = 15
APPLIES = "id string, stage_id string, base_digest string, after_digest string, auto_applied boolean, applied_by string, applied_at timestamp, reverted boolean"


def digest(text: Column) -> Column:
    """SHA-256 in hex; an empty text has an empty digest."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.sha2(text, 256))


def build(requests: DataFrame, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """Pending stages from requests: id, session_id, operation, original, modified, created_at (and what else they have)."""
    expires = F.col("created_at") + F.expr(f"INTERVAL {int(ttl_minutes)} MINUTES")
    return requests.withColumns({"base_digest": digest(F.col("original")), "after_digest": digest(F.col("modified")), "status": F.lit("pending"), "expires_at": expires})


def admit(stages: DataFrame, max_pending: int, already: DataFrame | None = None) -> DataFrame:
    """Adds admitted: a session's stages in order of creation, up to ``max_pending`` pending ones with those ``already`` there."""
    if max_pending <= 0:
        return stages.withColumn("admitted", F.lit(True))
    k = F.row_number().over(W.partitionBy("session_id").orderBy("created_at", "id"))
    if already is None:
        return stages.withColumn("admitted", k <= max_pending)
    have = already.filter("status = 'pending'").groupBy(F.col("session_id").alias("s")).agg(F.count("*").alias("have"))
    out = stages.withColumn("k", k).join(have, F.col("session_id") == F.col("s"), "left")
    return out.withColumn("admitted", F.col("k") + F.coalesce("have", F.lit(0)) <= max_pending).drop("k", "s", "have")


def pending(stages: DataFrame, session: str) -> DataFrame:
    """A session's pending stages, newest first."""
    return stages.filter((F.col("session_id") == session) & (F.col("status") == "pending")).orderBy(F.desc("created_at"), F.desc("id"))


def latest(stages: DataFrame) -> DataFrame:
    """The newest pending stage of each session; a maximum, combined before the shuffle."""
    rest = [c for c in stages.columns if c != "session_id"]
    newest = stages.filter("status = 'pending'").groupBy("session_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("r"))
    return newest.select("session_id", "r.*")


def expire(stages: DataFrame, now: Column) -> DataFrame:
    return stages.withColumn("status", F.when((F.col("status") == "pending") & (F.col("expires_at") < now), "expired").otherwise(F.col("status")))


def outcomes(stages: DataFrame, now: Column, hashes: DataFrame | None = None) -> DataFrame:
    """Adds what applying each stage comes to: ok, not_pending, expired or, where the current hash (id, hash) differs from
    the stage's base, changed."""
    out = F.when(F.col("status") != "pending", "not_pending").when(F.col("expires_at") < now, "expired")
    if hashes is None:
        return stages.withColumn("outcome", out.otherwise("ok"))
    joined = stages.join(hashes.select(F.col("id").alias("h_id"), "hash"), F.col("id") == F.col("h_id"), "left")
    changed = F.col("hash").isNotNull() & (F.col("hash") != F.col("base_digest"))
    return joined.withColumn("outcome", out.when(changed, "changed").otherwise("ok")).drop("h_id", "hash")


def attempted(outcome: DataFrame, stop: bool, key: str = "session_id") -> DataFrame:
    """What applying all of a session's stages comes to, in the order of their creation (then of id): with ``stop`` those behind
    the first whose outcome is not ok are not_attempted, otherwise failures are skipped.

    The first failure of a session is a minimum, combined before the shuffle, and met by its stages: nothing is sorted. Rows
    without a session are one.
    """
    if not stop:
        return outcome
    place = F.struct("created_at", "id")
    first = outcome.filter("outcome <> 'ok'").groupBy(F.col(key).alias("of")).agg(F.min(place).alias("first"))
    out = outcome.join(first, F.col(key).eqNullSafe(F.col("of")), "left")
    return out.withColumn("outcome", F.when(place > F.col("first"), "not_attempted").otherwise(F.col("outcome"))).drop("of", "first")


#: Folders that stages are dealt to by their id.
BUCKETS = 256


def bucket(id_: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def save(stages: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Append stages to ``folder``, dealt by a hash of their id: one file of each bucket."""
    dealt = stages.withColumn("bucket", bucket(F.col("id"), buckets))
    dealt.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(folder)


def lookup(saved: DataFrame, ids: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of those ``ids`` of what ``save`` wrote (read with its column bucket): only their buckets' folders are read."""
    session = saved.sparkSession
    places = [r.b for r in session.createDataFrame([(x,) for x in ids], "id string").select(bucket(F.col("id"), buckets).alias("b")).distinct().collect()] if ids else []
    return saved.filter(F.col("bucket").isin(places) & F.col("id").isin(list(ids))) if ids else saved.filter("false")


def within_limit(stages: DataFrame, applies: DataFrame, max_applies: int) -> DataFrame:
    """Stages whose session has applied less than ``max_applies`` (0: no limit), in order of creation. applies: of all
    sessions, with session_id. Stages without a session have no limit."""
    if max_applies <= 0:
        return stages
    done = applies.groupBy(F.col("session_id").alias("s")).agg(F.count("*").alias("done"))
    out = stages.withColumn("k", F.row_number().over(W.partitionBy("session_id").orderBy("created_at", "id"))).join(done, F.col("session_id") == F.col("s"), "left")
    free = F.coalesce("session_id", F.lit("")) == ""
    return out.filter(free | (F.col("k") + F.coalesce("done", F.lit(0)) <= max_applies)).drop("k", "s", "done")


def applies_of(stages: DataFrame, at: Column, auto: bool = False, by: str = "") -> DataFrame:
    """Rows of the table of applies for ``stages``."""
    return stages.select(F.concat(F.lit("apl_"), "id").alias("id"), F.col("id").alias("stage_id"), "base_digest", "after_digest", F.lit(auto).alias("auto_applied"), F.lit(by).alias("applied_by"), at.alias("applied_at"), F.lit(False).alias("reverted"))


def mark_applied(stages: DataFrame, applies: DataFrame) -> DataFrame:
    done = applies.select(F.col("stage_id").alias("done"), F.col("applied_at").alias("done_at"))
    out = stages.join(done, F.col("id") == F.col("done"), "left")
    return out.withColumns({"status": F.when(F.col("done").isNotNull(), "applied").otherwise(F.col("status")), "applied_at": F.col("done_at")}).drop("done", "done_at")


def finalize(stages: DataFrame, auto_apply: bool, threshold: float = 0.85) -> DataFrame:
    """Adds outcome: applied where auto-apply is on and the score reaches the threshold, else staged."""
    return stages.withColumn("outcome", F.when(F.lit(auto_apply) & (F.round("score", 9) >= threshold), "applied").otherwise("staged"))


def apply_counts(stages: DataFrame, applies: DataFrame) -> DataFrame:
    """Applies of each session that has any."""
    return applies.join(stages.select(F.col("id").alias("s"), "session_id"), F.col("stage_id") == F.col("s")).groupBy("session_id").agg(F.count("*").alias("n"))


def with_applies(stages: DataFrame, applies: DataFrame) -> DataFrame:
    """Every stage, with its apply's columns or nulls."""
    a = applies.select("stage_id", F.col("id").alias("apply_id"), F.col("applied_at").alias("apply_at"), "reverted")
    return stages.join(a, stages["id"] == a["stage_id"], "left")


def delete(stages: DataFrame, session: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Without a session's applied stages, or without those ids."""
    if session is not None:
        stages = stages.filter(~((F.col("session_id") == session) & (F.col("status") == "applied")))
    return stages.filter(~F.col("id").isin(ids)) if ids else stages


def metrics(done: DataFrame) -> DataFrame:
    """Of finished asynchronous creations (seconds, ok): counts, mean and largest time."""
    return done.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"))
