"""Fleet-level reports: rosters, roll-ups, loss windows, hotspot studies, alert expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.clock import micros
from quillon.operators import windows


def overview(shards: DataFrame, head: Column) -> DataFrame:
    """One row: shards in all, by status, at the head version, below it."""
    count = lambda c: F.count(F.when(c, 1))
    return shards.agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == "active").alias("active"), count(F.col("status") == "migrating").alias("migrating"), count(F.col("status") == "deleted").alias("deleted"),
        count((F.col("status") == "active") & (F.col("schema_version") == head)).alias("at_head"), count((F.col("status") == "active") & (F.col("schema_version") < head)).alias("behind"),
    )


def roster(nodes: DataFrame, alive: DataFrame) -> DataFrame:
    """The nodes, each with whether it is alive."""
    flags = alive.select("node_key", F.lit(True).alias("alive")).distinct()
    return nodes.join(flags, "node_key", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))


def live_members(nodes: DataFrame, now: Column, window_s: float, own: str) -> DataFrame:
    """Nodes seen within the window that have an address, in order, without oneself."""
    recent = micros(now) - micros(F.col("last_seen_at")) <= int(window_s * 1e6)
    return nodes.filter(recent & F.col("address").isNotNull() & (F.col("node_key") != own)).orderBy("node_key")


def warm_set(shards: DataFrame, checked: DataFrame, n: int) -> DataFrame:
    """The n most recently active shards, the longest unchecked first."""
    rows = shards.filter("status = 'active' AND last_active_at IS NOT NULL").orderBy(F.desc("last_active_at"), "shard_id").limit(n)
    return rows.join(checked.select("shard_id", "checked_at"), "shard_id", "left").orderBy(F.asc_nulls_first("checked_at"), "shard_id")


def loss_samples(acked: DataFrame, flushed: DataFrame, key: str) -> DataFrame:
    """What a loss at each acknowledgement would cost: rows and milliseconds since the last flush at or before it.

    acked and flushed: key, at, rows (counts so far). The flush is found by one ordered pass over both, not by a
    range join.
    """
    both = acked.select(key, "at", "rows", F.lit(1).alias("kind")).union(flushed.select(key, "at", "rows", F.lit(0).alias("kind")))
    own = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("at", "rows")), ignorenulls=True).over(own)
    rows = both.withColumn("_last", last).filter("kind = 1")
    ms = (micros(F.col("at")) - micros(F.col("_last.at"))) / 1000
    return rows.select(key, "at", (F.col("rows") - F.coalesce("_last.rows", F.lit(0))).alias("lost_rows"), F.greatest(ms, F.lit(0.0)).alias("lost_ms"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """p50, p90, p99, max and the rounded mean; one row."""
    p = lambda q: F.percentile(value, F.lit(q))
    return df.agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(value).alias("max"), F.round(F.avg(value)).cast("bigint").alias("mean"))


def threshold_sweep(rates: DataFrame, key: str, rate: str, thresholds: Sequence[float], top: int) -> DataFrame:
    """For each threshold: how many keys are over it, and the share of the true top keys that it finds.

    One aggregation; the thresholds are columns of it, so no product with the rows is formed.
    """
    true_top = rates.orderBy(F.desc(rate), key).limit(top).select(key).withColumn("_top", F.lit(True))
    marked = rates.join(F.broadcast(true_top), key, "left")
    sums = [F.struct(F.lit(float(x)).alias("threshold"), F.count(F.when(F.col(rate) >= x, 1)).alias("flagged"), (F.count(F.when(F.col("_top") & (F.col(rate) >= x), 1)) / F.greatest(F.count("_top"), F.lit(1))).alias("recall")) for x in thresholds]
    return marked.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def increase(df: DataFrame, keys: list[str], at: str, counter: str, window: str) -> DataFrame:
    """Growth of a counter by keys and aligned window, resets counted from zero, and the rate per second."""
    own = Window.partitionBy(*keys).orderBy(at)
    before = F.lag(counter).over(own)
    grown = F.when(before.isNull(), F.lit(0.0)).when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before)
    out = df.withColumn("_grown", grown).groupBy(*keys, F.window(at, window).alias("w")).agg(F.sum("_grown").alias("increase"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("w.start"), F.col("w.end")) / 1e6
    return out.select(*keys, F.col("w.start").alias("start"), "increase", (F.col("increase") / seconds).alias("rate"))


def tpcb_consistent(branches: DataFrame, tellers: DataFrame, accounts: DataFrame, history: DataFrame, writer: str, n: int) -> DataFrame:
    """One row: whether the four sums agree, no row is foreign, and all n transactions are there."""
    b, t, a = (df.agg(F.sum(c).alias(c)) for df, c in ((branches, "bbalance"), (tellers, "tbalance"), (accounts, "abalance")))
    h = history.agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("filler") != writer, 1)).alias("strange"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums_agree = (zero("bbalance") == zero("tbalance")) & (zero("tbalance") == zero("abalance")) & (zero("abalance") == zero("delta"))
    return b.join(t).join(a).join(h).select(sums_agree.alias("sums_agree"), (F.col("strange") == 0).alias("isolated"), (F.col("n") == n).alias("complete"))


def revert_status(shards: DataFrame, jobs: DataFrame, version: int) -> DataFrame:
    """One row: shards still on a version, those with a job under way, those whose job failed."""
    on = shards.filter((F.col("schema_version") == version) & (F.col("status") != "deleted"))
    state = jobs.groupBy("shard_id").agg(F.bool_or(F.col("state").isin("available", "scheduled", "executing", "retryable")).alias("flying"), F.bool_or(F.col("state") == "discarded").alias("failed"))
    return on.join(state, "shard_id", "left").agg(F.count(F.lit(1)).alias("remaining"), F.count(F.when(F.col("flying"), 1)).alias("in_flight"), F.count(F.when(F.col("failed") & ~F.col("flying"), 1)).alias("failed"))


def stranded(shards: DataFrame, versions: DataFrame, head: Column) -> DataFrame:
    """Live shards on a yanked version above the head."""
    yanked = versions.filter("yanked").select(F.col("version").alias("schema_version"))
    return shards.filter((F.col("status") != "deleted") & (F.col("schema_version") > head)).join(yanked, "schema_version", "left_semi")


def stalled_jobs(jobs: DataFrame, now: Column, age_s: float) -> DataFrame:
    """One row: jobs that wait or run for longer than the age."""
    old = micros(now) - micros(F.col("scheduled_at")) > int(age_s * 1e6)
    return jobs.filter(F.col("state").isin("available", "retryable", "executing") & old).agg(F.count(F.lit(1)).alias("stalled"))


def dirty(written: DataFrame, flushed: DataFrame, key: str) -> DataFrame:
    """Keys whose writes are not all flushed: another generation, or a count beyond the flushed one."""
    w = windows.latest(written, [key], "at", ["count"]).select(key, "gen", "count")
    f = windows.latest(flushed, [key], "at", ["count"]).select(key, F.col("gen").alias("f_gen"), F.col("count").alias("f_count"))
    unflushed = F.col("f_gen").isNull() | (F.col("gen") != F.col("f_gen")) | (F.col("count") > F.col("f_count"))
    return w.join(f, key, "left").filter(unflushed).select(key)


def dirty_age(shards: DataFrame, now: Column) -> DataFrame:
    """One row: shards with unflushed activity and the age in seconds of the oldest."""
    unflushed = F.col("last_active_at").isNotNull() & (F.col("last_flushed_at").isNull() | (F.col("last_active_at") > F.col("last_flushed_at")))
    age = (micros(now) - micros(F.col("last_active_at"))) / 1e6
    return shards.agg(F.count(F.when(unflushed, 1)).alias("dirty"), F.coalesce(F.max(F.when(unflushed, F.greatest(age, F.lit(0.0)))), F.lit(0.0)).alias("oldest_s"))


def transaction_summary(txns: DataFrame) -> DataFrame:
    """By kind: count and latency percentiles (microseconds); over all kinds: their rate a minute. txns: kind, began, us."""
    p = lambda q: F.percentile("us", F.lit(q))
    by_kind = txns.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.99).alias("p99"), F.max("us").alias("max"))
    began = micros(F.col("began"))
    span = txns.agg(((F.max(began + F.col("us")) - F.min(began)) / 6e7).alias("minutes"))
    return by_kind.join(F.broadcast(span)).select("kind", "n", "p50", "p99", "max", (F.col("n") / F.when(F.col("minutes") > 0, F.col("minutes"))).alias("per_minute"))


def best_copy(stored: DataFrame, offers: DataFrame, own: str) -> DataFrame:
    """The freshest offer of each shard that is strictly fresher than the stored object; local first among equals, then by node.

    stored: shard_id, epoch, gen, pos. offers: the same and node. A shard without one keeps the object.
    """
    stamp = lambda *p: F.struct(*(F.coalesce(F.col(f"{x}{c}"), F.lit(-1)).alias(c) for x in p for c in ("epoch", "gen", "pos")))
    s = stored.select("shard_id", F.struct(*(F.coalesce(c, F.lit(-1)).alias(c) for c in ("epoch", "gen", "pos"))).alias("_stored"))
    rows = offers.withColumn("_offer", stamp("")).join(s, "shard_id").filter(F.col("_offer") > F.col("_stored"))
    best = rows.groupBy("shard_id").agg(F.max_by("node", F.struct("_offer", F.col("node") == own, "node")).alias("node"))
    return stored.select("shard_id").join(best, "shard_id", "left").select("shard_id", F.coalesce("node", F.lit("object")).alias("source"))


def still_valid(etag_before: Column, etag_now: Column, stamp_offer: Column, stamp_now: Column) -> Column:
    """Whether a choice still holds after a slow transfer: object_moved, object_advanced or ok."""
    return F.when(~etag_before.eqNullSafe(etag_now), "object_moved").when(stamp_now >= stamp_offer, "object_advanced").otherwise("ok")


def affinity(moves: DataFrame, warm: DataFrame) -> DataFrame:
    """Moves with whether their target had the shard warm."""
    w = warm.select("shard_id", F.col("node_key").alias("to_node"), F.lit(True).alias("hit")).distinct()
    return moves.join(w, ["shard_id", "to_node"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def audit(entries: DataFrame, limit: int, **filters: str) -> DataFrame:
    """The newest entries, by exact filters on columns."""
    for column, value in filters.items():
        entries = entries.filter(F.col(column) == F.lit(value))
    return entries.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def refreshed(seen: DataFrame, source: DataFrame, since: Column) -> DataFrame:
    """What was seen and what changed since, with an overlap: each row once."""
    return seen.union(source.filter(F.col("updated_at") >= since).select(*seen.columns)).distinct()


def queue_gauges(jobs: DataFrame, queues: Sequence[str], states: Sequence[str], aged: str, now: Column) -> DataFrame:
    """A row for each configured queue: a count for each state, and the age in seconds of the oldest job in state ``aged``; 0 where there is none."""
    oldest = F.min(F.when(F.col("state") == aged, F.col("at")))
    found = jobs.filter(F.col("queue").isin(*queues)).groupBy("queue").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in states), oldest.alias("oldest"))
    known = jobs.sparkSession.createDataFrame([(q,) for q in queues], "queue string")
    age = F.greatest(F.timestamp_diff("SECOND", F.col("oldest"), now), F.lit(0))
    return known.join(F.broadcast(found), "queue", "left").select("queue", *(F.coalesce(s, F.lit(0)).alias(s) for s in states), F.coalesce(age, F.lit(0)).alias("age_s"))


def job_counts(jobs: DataFrame, states: Sequence[str]) -> DataFrame:
    """Jobs by queue and state, of the states that count."""
    return jobs.filter(F.col("state").isin(*states)).groupBy("queue", "state").agg(F.count(F.lit(1)).alias("n"))


def audit_filter(rows: DataFrame, equal: dict[str, object], least: dict[str, object]) -> DataFrame:
    """The rows that match every filter that is given; one that is None doesn't count."""
    for column, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(column) == F.lit(value))
    for column, value in least.items():
        rows = rows if value is None else rows.filter(F.col(column) >= F.lit(value))
    return rows


def membership(current: Sequence[str], live: Sequence[str], least: int) -> list[str]:
    """The set to replicate over: the live nodes, or the current set while fewer than ``least`` are live."""
    return sorted(live) if len(live) >= least else list(current)
