"""Fleet reports over directory-like tables: losses, laggards, versions, retention, reconciliation, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.clock import micros
from quillon.operators import joins

STAMP = "^([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})Z.*$"


def loss_report(shards: DataFrame, limit: int) -> DataFrame:
    """Not deleted, active, and never flushed or active after the flush; the newest first."""
    at_risk = F.col("last_flushed_at").isNull() | (F.col("last_active_at") > F.col("last_flushed_at"))
    return shards.filter((F.col("status") != "deleted") & F.col("last_active_at").isNotNull() & at_risk).orderBy(F.desc("last_active_at"), "shard_id").limit(limit)


def drill_sample(shards: DataFrame, checked: str, limit: int) -> DataFrame:
    """Active rows, those never checked first, then the longest unchecked."""
    return shards.filter("status = 'active'").orderBy(F.asc_nulls_first(checked), "shard_id").limit(limit)


def laggards(shards: DataFrame, head: Column, template: str, limit: int | None = None) -> DataFrame:
    """Active rows below the head version, the most recently active first, without the template."""
    rows = shards.filter((F.col("status") == "active") & (F.col("schema_version") < head) & (F.col("shard_id") != template)).orderBy(F.desc_nulls_last("last_active_at"), "shard_id")
    return rows if limit is None else rows.limit(limit)


def head_version(versions: DataFrame) -> DataFrame:
    """head: the greatest version not yanked that is below the first one awaiting review; 0 without one. One row."""
    barrier = versions.agg(F.min(F.when(F.col("requires_review"), F.col("version"))).alias("barrier"))
    good = ~F.col("yanked") & (F.col("barrier").isNull() | (F.col("version") < F.col("barrier")))
    return versions.join(F.broadcast(barrier)).agg(F.coalesce(F.max(F.when(good, F.col("version"))), F.lit(0)).cast("bigint").alias("head"))


def next_version(versions: DataFrame) -> DataFrame:
    """next: one above the greatest version, yanked or not; 1 without one. One row."""
    return versions.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("bigint").alias("next"))


def revoked_floors(directory: DataFrame) -> DataFrame:
    """shard_id and token_version of those whose tokens were ever revoked: a floor above the first."""
    return directory.filter("token_version > 1").select("shard_id", "token_version")


def rollout_eta(remaining: Column, cut_over: Column, window_s: float) -> Column:
    """Seconds until no row lags at the rate of the window; 0 if none does, NULL without a rate."""
    return F.when(remaining == 0, F.lit(0)).when(cut_over > 0, F.ceil(remaining / (cut_over / F.lit(window_s)))).cast("bigint")


def outstanding_tokens(issued: DataFrame, floors: DataFrame) -> DataFrame:
    """Issuances still accepted: version at the shard's floor or over (1 without a floor)."""
    known = issued.join(floors.select("shard_id", "token_version"), "shard_id", "left") if "token_version" not in issued.columns else issued.withColumnRenamed("token_version", "issued_version").join(floors.select("shard_id", "token_version"), "shard_id", "left")
    return known.filter(F.col("issued_version") >= F.coalesce("token_version", F.lit(1))).drop("token_version")


def token_accepted(version: Column, floor: Column, bumped_at: Column, now: Column, grace_s: float, hard: Column) -> Column:
    """At the floor or over; one below it within the grace, unless the revocation was hard."""
    young = micros(now) <= micros(bumped_at) + int(grace_s * 1e6)
    return (version >= floor) | ((version == floor - 1) & ~hard & F.coalesce(young, F.lit(False)))


def reconcile(directory: DataFrame, stored: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Findings (shard_id, kind, from_value, to_value): missing_object, schema_drift, token_drift, orphan_tombstone."""
    live = directory.filter("status <> 'deleted'")
    both = live.join(stored.select("shard_id", "user_version", "token_floor"), "shard_id", "left")
    current = F.coalesce("token_version", F.lit(0)).cast("bigint")
    findings = F.array_compact(
        F.array(
            F.when(F.col("user_version").isNull(), F.struct(F.lit("missing_object").alias("kind"), F.lit(None).cast("bigint").alias("from_value"), F.lit(None).cast("bigint").alias("to_value"))),
            F.when(F.col("user_version") != F.col("schema_version"), F.struct(F.lit("schema_drift").alias("kind"), F.col("schema_version").cast("bigint").alias("from_value"), F.col("user_version").cast("bigint").alias("to_value"))),
            F.when(F.col("token_floor") > current, F.struct(F.lit("token_drift").alias("kind"), current.alias("from_value"), F.col("token_floor").cast("bigint").alias("to_value"))),
        )
    )
    rows = both.select("shard_id", F.explode(findings).alias("f")).select("shard_id", "f.*")
    orphans = joins.absent(tombstones.select("shard_id"), directory.filter("status = 'deleted'").select("shard_id"), "shard_id")
    none = F.lit(None).cast("bigint")
    return rows.unionByName(orphans.select("shard_id", F.lit("orphan_tombstone").alias("kind"), none.alias("from_value"), none.alias("to_value")))


def retention(ids: DataFrame, now: Column, hourly: int, daily: int, weekly: int, owner: str | None = None) -> DataFrame:
    """Adds ``plan`` to snapshot ids: keep, drop, or ineligible (not automatic, or without a stamp).

    The newest of each of the newest populated hours, days and ISO weeks is kept, and all that lie in the future.
    Periods are found by partial aggregation, so only period rows are ranked, not snapshots.
    """
    stamp = F.regexp_replace("id", STAMP, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz")
    keys = [owner] if owner else []
    rows = ids.withColumn("ts", F.when(F.col("id").endswith("-auto") & F.col("id").rlike(STAMP), stamp))
    rows = rows.withColumn("week", F.expr("extract(YEAROFWEEK FROM ts) * 100 + weekofyear(ts)"))
    kept = None
    for period, count in ((F.date_format("ts", "yyyyMMddHH").cast("bigint"), hourly), (F.date_format("ts", "yyyyMMdd").cast("bigint"), daily), (F.col("week").cast("bigint"), weekly)):
        newest = rows.filter("ts IS NOT NULL").groupBy(*keys, period.alias("period")).agg(F.max(F.struct("ts", "id")).alias("r"))
        rank = F.row_number().over(Window.partitionBy(*keys, F.lit(1)).orderBy(F.desc("r.ts")))
        some = newest.withColumn("rn", rank).filter(F.col("rn") <= count).select(*keys, F.col("r.id").alias("id"))
        kept = some if kept is None else kept.union(some)
    kept = kept.distinct().withColumn("_kept", F.lit(True))
    plan = F.when(F.col("ts").isNull(), "ineligible").when(F.col("_kept") | (F.col("ts") > now.cast("timestamp_ntz")), "keep").otherwise("drop")
    return rows.join(kept, [*keys, "id"], "left").withColumn("plan", plan).drop("_kept", "week")


def gate(parent: DataFrame, new: DataFrame, metrics: DataFrame, warn: float = 20.0) -> DataFrame:
    """Per metric (metric, direction, block): percent of change for the worse, skipped for NULL or a zero parent, and its verdict."""
    rows = metrics.join(parent.select("metric", F.col("value").alias("parent")), "metric", "left").join(new.select("metric", F.col("value").alias("new")), "metric", "left")
    skipped = F.col("parent").isNull() | F.col("new").isNull() | (F.col("parent") == 0)
    worse = F.when(F.col("direction") == "higher_worse", F.col("new") - F.col("parent")).otherwise(F.col("parent") - F.col("new"))
    rows = rows.withColumn("pct", F.when(skipped, F.lit(None)).otherwise(F.round(worse / F.when(F.col("parent") != 0, F.col("parent")) * 100, 2)))
    return rows.withColumn("verdict", F.when(F.col("pct").isNull(), "skipped").when(F.col("pct") >= F.col("block"), "block").when(F.col("pct") > warn, "warn").otherwise("ok"))


def gate_verdict(rows: DataFrame) -> DataFrame:
    """block, warn, ok or no_data over all metrics, and the worst change. One row."""
    worst = rows.agg(F.max("pct").alias("worst"), F.bool_or(F.col("verdict") == "block").alias("b"), F.bool_or(F.col("verdict") == "warn").alias("w"))
    return worst.select(F.when(F.col("worst").isNull(), "no_data").when(F.col("b"), "block").when(F.col("w"), "warn").otherwise("ok").alias("verdict"), F.coalesce("worst", F.lit(0.0)).alias("worst"))


def template_drift(fleet: Column, template: Column) -> Column:
    return F.when(fleet.isNull() | template.isNull(), "unknown").when(fleet == template, "aligned").otherwise("drift")


def retire_action(live: Column, reverting: Column) -> Column:
    return F.when(live | reverting, "cancel").otherwise("drop")


def review_reason(data_statements: Column, gap: Column) -> Column:
    return F.when((data_statements > 0) & gap, "both").when(data_statements > 0, "data_migration").when(gap, "migration_gap")


def lint(files: DataFrame) -> DataFrame:
    """Findings (path, rule, severity) over migration sources (path, value: the whole text)."""
    rules = [("atomic_false", "error", r"(?m)^\s*atomic\s*=\s*False"), ("run_python", "warning", r"\bRunPython\s*\("), ("run_sql", "warning", r"\bRunSQL\s*\(")]
    found = F.array_compact(F.array(*(F.when(F.col("value").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p in rules)))
    return files.select("path", F.explode(found).alias("f")).select("path", "f.*")
