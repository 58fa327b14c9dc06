"""Hot-key detection and move planning over load samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.clock import micros
from quillon.operators import windows


def hot_threshold(rates: DataFrame, rate: str, *, floor: float = 0.0, multiple: float = 20.0, fleet_mode: bool = False, fleet_p99: float | None = None) -> Column:
    """Aggregate: a positive floor; else the multiple of the fleet's p99 (0 without one in fleet mode); else of the rates' own p99."""
    if floor > 0:
        return F.lit(float(floor))
    if fleet_mode:
        return F.lit(0.0 if fleet_p99 is None else multiple * fleet_p99)
    return F.coalesce(F.percentile(F.col(rate).cast("double"), F.lit(0.99)), F.lit(0.0)) * multiple


def node_load(samples: DataFrame, key: str, node: str, at: str, rate: str) -> DataFrame:
    """Sum of the latest rates by node."""
    return windows.latest(samples, [key], at, [node]).groupBy(node).agg(F.sum(rate).alias("load"))


def cooling(overrides: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Keys moved less than so many seconds ago; an unknown time counts as just now."""
    recent = micros(now) - micros(F.col("updated_at")) < seconds * 1e6
    return overrides.filter(F.coalesce(recent, F.lit(True))).select("shard_id")


def hot(samples: DataFrame, threshold: float, backends: list[str], cool: DataFrame, confirm: int) -> DataFrame:
    """Confirmed hot rows on known nodes, hottest first."""
    if threshold <= 0:
        return samples.limit(0)
    now = windows.latest(samples, ["shard_id"], "sampled_at", ["node_key"])
    sure = windows.confirmed(samples, "shard_id", "node_key", "sampled_at", "q_per_s", threshold, confirm, ["node_key"])
    rows = now.filter((F.col("q_per_s") >= threshold) & F.col("node_key").isin(backends))
    return rows.join(cool, "shard_id", "left_anti").join(sure.select("shard_id"), "shard_id", "left_semi").orderBy(F.desc("q_per_s"), "shard_id")


def choose_target(rate: float, source: str, load: dict[str, float], nodes: list[str], warm: set[str], band: float) -> str | None:
    """The least loaded node that stays below the source's load; a warm one if it is within band times the rate of the least."""
    limit = load.get(source, rate)
    viable = {n: load.get(n, 0.0) for n in nodes if n != source and load.get(n, 0.0) + rate < limit}
    if not viable:
        return None
    ceiling = min(viable.values()) + band * rate
    near = {n: v for n, v in viable.items() if n in warm and v <= ceiling}
    return min((near or viable).items(), key=lambda x: (x[1], x[0]))[0]


def propose(
    samples: DataFrame, overrides: DataFrame, backends: list[str], now: Column, *, floor: float = 0.0, multiple: float = 20.0, fleet_mode: bool = False, fleet_p99: float | None = None,
    confirm: int = 2, cooldown_s: float = 300, max_moves: int = 1, warm: DataFrame | None = None, band: float = 0.5, alive: list[str] | None = None,
) -> list[dict]:
    """Moves (shard_id, from_node, to_node, q_per_s, threshold).

    Detection is distributed. The fold over the hot rows, the hottest first, is not: it takes them a partition at a
    time until there are ``max_moves``, or none is left. The loads it keeps are one number a node.
    """
    if max_moves <= 0:
        return []
    last = windows.latest(samples, ["shard_id"], "sampled_at", ["node_key"])
    threshold = last.agg(hot_threshold(last, "q_per_s", floor=floor, multiple=multiple, fleet_mode=fleet_mode, fleet_p99=fleet_p99).alias("t")).first()["t"] or 0.0
    rows = hot(samples, threshold, backends, cooling(overrides, now, cooldown_s), confirm)
    if warm is not None:
        at = warm.groupBy("shard_id").agg(F.collect_set("node_key").alias("warm"))  # one entry a node at most
        rows = rows.join(at, "shard_id", "left").orderBy(F.desc("q_per_s"), "shard_id")
    load = {r["node_key"]: r["load"] for r in node_load(samples, "shard_id", "node_key", "sampled_at", "q_per_s").collect()}
    targets = [n for n in backends if not alive or n in alive]
    moves: list[dict] = []
    for r in rows.toLocalIterator():
        to = choose_target(r["q_per_s"], r["node_key"], load, targets, set(r["warm"] or ()) if warm is not None else set(), band)
        if to is not None:
            moves.append({"shard_id": r["shard_id"], "from_node": r["node_key"], "to_node": to, "q_per_s": r["q_per_s"], "threshold": threshold})
            load[to] = load.get(to, 0.0) + r["q_per_s"]
            load[r["node_key"]] = max(load.get(r["node_key"], 0.0) - r["q_per_s"], 0.0)
        if len(moves) >= max_moves:
            break
    return moves


def dead_pins(overrides: DataFrame, alive: DataFrame, in_flight: DataFrame, leases: DataFrame, now: Column, grace_s: float = 300) -> DataFrame:
    """What becomes of pins to nodes that are not alive: in_flight, grace, unpin (lease free) or divergence. Nothing, if no node is alive."""
    some = alive.limit(1).withColumn("_some", F.lit(True)).select("_some")
    pins = overrides.filter("failed_at IS NULL").join(alive, F.col("pinned_node") == F.col("node_key"), "left_anti").join(F.broadcast(some))
    pins = pins.join(in_flight.select("shard_id", F.lit(True).alias("_flying")), "shard_id", "left").join(leases.select("shard_id", "owner"), "shard_id", "left")
    young = micros(now) - micros(F.col("updated_at")) < grace_s * 1e6
    action = F.when(F.col("_flying"), "in_flight").when(young, "grace").when(F.col("owner").isNull(), "unpin").otherwise("divergence")
    return pins.select("shard_id", "pinned_node", action.alias("action"))
