"""Rates, histograms, planning, reports: small cases worked out by hand or by a plain fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import histograms, joins, paging, upserts, windows
from quillon.plans import fleet, policy
from quillon.sources import generators, prometheus

NOW = dt.datetime(2024, 5, 1, 12)


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def one(df):
    return df.first()[0]


def plain_percentile(counts, p, edges):
    total = sum(counts)
    target, seen = p / 100 * total, 0
    for i, c in enumerate(counts):
        if c and seen + c >= target:
            return edges[i] if i + 1 == len(edges) else edges[i] + (target - seen) / c * (edges[i + 1] - edges[i])
        seen += c
    return 0.0


def test_histogram_percentiles(spark):
    r = random.Random(3)
    vectors = [[0] * 16, [0] * 15 + [4]] + [[r.choice([0, 0, 1, 5, 40]) for _ in range(16)] for _ in range(20)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, h array<bigint>")
    for p in (1, 50, 99, 100):
        got = [x[0] for x in df.orderBy("i").select(histograms.percentile(F.col("h"), p)).collect()]
        assert got == pytest.approx([plain_percentile(v, p, histograms.RATE_EDGES) for v in vectors])


def test_buckets_and_merging(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.99,), (1.0,), (4.9,), (5.0,), (1e9,), (None,)], "v double")
    h = one(df.agg(histograms.histogram(F.col("v"))))
    assert h[:4] == [3, 1, 1, 1] and h[15] == 1 and sum(h) == 7
    vectors = spark.createDataFrame([([1] * 16,), (list(range(16)),), ([1, 2],), (None,)], "h array<bigint>")
    assert one(vectors.agg(histograms.merged(F.col("h")))) == [i + 1 for i in range(16)]
    assert one(spark.createDataFrame([], "h array<bigint>").agg(histograms.merged(F.col("h")))) == [0] * 16


def test_cumulative_percentile(spark):
    inf = float("inf")
    rows = [([(1.0, 0.0), (2.0, 5.0), (4.0, 5.0), (inf, 10.0)], 4.0), ([(1.0, 10.0), (inf, 10.0)], 0.99), ([(1.0, 0.0), (inf, 0.0)], 0.0), ([], 0.0), ([(1.0, 4.0), (3.0, 8.0), (inf, 8.0)], 2.96)]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(rows)], "i int, b array<struct<le: double, cum: double>>")
    got = [x[0] for x in df.orderBy("i").select(histograms.percentile_cumulative(F.col("b"), 99)).collect()]
    assert got == pytest.approx([w for _, w in rows])


def test_exact_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double")
    assert one(df.agg(histograms.exact_percentile("v", 99))) == pytest.approx(9.84)
    assert one(df.limit(0).agg(histograms.exact_percentile("v", 99))) == 0.0
    assert one(df.agg(histograms.nearest_rank("v", 50))) == 2.0


def test_rates_and_resets(spark):
    df = spark.createDataFrame([("a", at(0), 10.0), ("a", at(1), 70.0), ("a", at(2), 6.0), ("b", at(0), 1.0), ("b", at(0) + dt.timedelta(microseconds=1), 2.0)], "k string, t timestamp_ntz, v double")
    got = {(r["k"], r["t"]): r["rate"] for r in windows.counter_rate(df, "k", "t", "v").collect()}
    assert got[("a", at(0))] is None and got[("a", at(1))] == 1.0 and got[("a", at(2))] == pytest.approx(0.1) and got[("b", at(0) + dt.timedelta(microseconds=1))] == pytest.approx(1000.0)


def test_windowed_vectors(spark):
    df = spark.createDataFrame([("a", 1, [5, 5]), ("a", 2, [7, 3])], "k string, t int, h array<bigint>")
    assert [r["diff"] for r in histograms.windowed(df, "k", "t", "h").orderBy("t").collect()] == [[5, 5], [2, 0]]


SAMPLES = "shard_id string, node_key string, sampled_at timestamp_ntz, q_per_s double"


def samples(spark, rows):
    return spark.createDataFrame([(s, n, at(m), q) for s, n, m, q in rows], SAMPLES)


def none(spark):
    return spark.createDataFrame([], "shard_id string, updated_at timestamp_ntz")


def moves(spark, rows, nodes, **options):
    options = {"floor": 50.0, "overrides": none(spark)} | options
    return [(m["shard_id"], m["from_node"], m["to_node"]) for m in policy.propose(samples(spark, rows), options.pop("overrides"), nodes, F.lit(NOW), **options)]


HOT = [("hot", "a", -1, 100.0), ("hot", "a", -2, 90.0), ("other", "a", -1, 30.0), ("cold", "b", -1, 5.0)]


def test_a_confirmed_hot_shard_moves(spark):
    assert moves(spark, HOT, ["a", "b", "c"]) == [("hot", "a", "c")]
    assert moves(spark, HOT, ["a"]) == []
    assert moves(spark, HOT[:1] + HOT[2:], ["a", "b"]) == []  # one window only
    assert moves(spark, HOT, ["a", "b"], max_moves=0) == []
    assert moves(spark, HOT, ["b", "c"]) == []  # its node is unknown
    assert moves(spark, HOT, ["a", "b", "c"], alive=["b"]) == [("hot", "a", "b")]
    assert moves(spark, HOT, ["a", "b", "c"], alive=[]) == [("hot", "a", "c")]


def test_cooling_and_warmth(spark):
    fresh = spark.createDataFrame([("hot", at(-1))], "shard_id string, updated_at timestamp_ntz")
    unknown = spark.createDataFrame([("hot", None)], "shard_id string, updated_at timestamp_ntz")
    old = spark.createDataFrame([("hot", at(-10))], "shard_id string, updated_at timestamp_ntz")
    assert moves(spark, HOT, ["a", "b"], overrides=fresh) == moves(spark, HOT, ["a", "b"], overrides=unknown) == []
    assert moves(spark, HOT, ["a", "b"], overrides=old) == [("hot", "a", "b")]
    warm = spark.createDataFrame([("hot", "b")], "shard_id string, node_key string")
    assert moves(spark, HOT, ["a", "b", "c"], warm=warm) == [("hot", "a", "b")]
    assert moves(spark, HOT, ["a", "b", "c"], warm=warm, band=0.0) == [("hot", "a", "c")]


def test_a_move_must_improve_the_balance(spark):
    rows = [("x", "a", -1, 60.0), ("x", "a", -2, 60.0), ("y", "b", -1, 60.0), ("y", "b", -2, 60.0)]
    assert moves(spark, rows, ["a", "b"], max_moves=5) == []
    rows += [("z", "a", -1, 55.0), ("z", "a", -2, 55.0)]
    assert moves(spark, rows, ["a", "b", "c"], max_moves=5) == [("x", "a", "c")]


def test_thresholds(spark):
    df = samples(spark, HOT)
    t = lambda **o: one(df.agg(policy.hot_threshold(df, "q_per_s", **o)))
    assert t(floor=7.0) == 7.0 and t(fleet_mode=True) == 0.0 and t(fleet_mode=True, fleet_p99=3.0) == 60.0
    assert t() == pytest.approx(20 * 99.7)
    assert moves(spark, HOT, ["a", "b"], floor=0.0, fleet_mode=True) == []


def test_dead_pins(spark):
    pins = spark.createDataFrame([("a", "n1", None, at(-60)), ("b", "n9", None, at(-60)), ("c", "n9", None, at(-1)), ("d", "n9", None, at(-60)), ("e", "n9", at(-1), at(-60)), ("f", "n9", None, at(-60))], "shard_id string, pinned_node string, failed_at timestamp_ntz, updated_at timestamp_ntz")
    alive = spark.createDataFrame([("n1",)], "node_key string")
    flying = spark.createDataFrame([("d",)], "shard_id string")
    leases = spark.createDataFrame([("f", "n9")], "shard_id string, owner string")
    got = {r["shard_id"]: r["action"] for r in policy.dead_pins(pins, alive, flying, leases, F.lit(NOW)).collect()}
    assert got == {"b": "unpin", "c": "grace", "d": "in_flight", "f": "divergence"}
    assert policy.dead_pins(pins, alive.filter("false"), flying, leases, F.lit(NOW)).collect() == []


def test_retention(spark):
    ids = ["20240501T110500Z-a-auto", "20240501T115900Z-b-auto", "20240430T010000Z-c-auto", "20240101T000000Z-d-auto", "20240501T110000Z-e", "garbage-auto", "20990101T000000Z-f-auto", "20240501T110000Z-g-auto"]
    plan = {r["id"][-6:]: r["plan"] for r in fleet.retention(spark.createDataFrame([(i,) for i in ids], "id string"), F.lit(NOW), 1, 2, 2).collect()}
    assert plan == {"a-auto": "drop", "b-auto": "keep", "c-auto": "drop", "d-auto": "drop", "000Z-e": "ineligible", "e-auto": "ineligible", "f-auto": "keep", "g-auto": "drop"}


def test_gate(spark):
    value = "metric string, value double"
    parent = spark.createDataFrame([("lat", 100.0), ("tps", 100.0), ("zero", 0.0), ("ok", 10.0)], value)
    new = spark.createDataFrame([("lat", 125.0), ("tps", 70.0), ("zero", 5.0), ("ok", 10.5)], value)
    metrics = spark.createDataFrame([("lat", "higher_worse", 50.0), ("tps", "lower_worse", 20.0), ("zero", "higher_worse", 20.0), ("none", "higher_worse", 20.0), ("ok", "higher_worse", 20.0)], "metric string, direction string, block double")
    rows = fleet.gate(parent, new, metrics)
    assert {r["metric"]: (r["pct"], r["verdict"]) for r in rows.collect()} == {"lat": (25.0, "warn"), "tps": (30.0, "block"), "zero": (None, "skipped"), "none": (None, "skipped"), "ok": (5.0, "ok")}
    assert tuple(fleet.gate_verdict(rows).first()) == ("block", 30.0)
    assert tuple(fleet.gate_verdict(rows.filter("pct IS NULL")).first()) == ("no_data", 0.0)


def test_small_rules(spark):
    df = spark.createDataFrame([(2, 2, at(-1), False), (1, 2, at(-1), False), (1, 2, at(-100), False), (1, 2, at(-1), True), (0, 2, at(-1), False)], "v int, f int, b timestamp_ntz, h boolean")
    assert [r[0] for r in df.select(fleet.token_accepted(F.col("v"), F.col("f"), F.col("b"), F.lit(NOW), 600, F.col("h"))).collect()] == [True, True, False, False, False]
    l = F.lit  # noqa: E741
    row = spark.range(1).select(
        fleet.template_drift(l(1), l(1)), fleet.template_drift(l(1), l(2)), fleet.template_drift(l(None), l(2)), fleet.retire_action(l(False), l(True)), fleet.retire_action(l(False), l(False)),
        fleet.review_reason(l(1), l(True)), fleet.review_reason(l(1), l(False)), fleet.review_reason(l(0), l(True)), fleet.review_reason(l(0), l(False)), fleet.rollout_eta(l(0), l(0), 60), fleet.rollout_eta(l(5), l(0), 60), fleet.rollout_eta(l(5), l(2), 60),
    ).first()
    assert tuple(row) == ("aligned", "drift", "unknown", "cancel", "drop", "both", "data_migration", "migration_gap", None, 0, None, 150)


def test_lint(spark):
    files = spark.createDataFrame([("a.py", "class M:\n    atomic = False\n    x = RunPython(f)"), ("b.py", "RunSQL('x')"), ("c.py", "pass")], "path string, value string")
    assert {tuple(r) for r in fleet.lint(files).collect()} == {("a.py", "atomic_false", "error"), ("a.py", "run_python", "warning"), ("b.py", "run_sql", "warning")}


def test_writes(spark):
    table = spark.createDataFrame([("a", at(0), 5), ("b", None, 6)], "k string, t timestamp_ntz, n int")
    batch = spark.createDataFrame([("a", at(-5)), ("b", at(1)), ("b", at(2)), ("c", at(3))], "k string, t timestamp_ntz")
    got = {r["k"]: (r["t"], r["n"]) for r in upserts.newest_wins(table, batch, "k", "t", {"n": F.lit(1)}).collect()}
    assert got == {"a": (at(0), 5), "b": (at(2), 6), "c": (at(3), 1)}
    assert {r["k"]: r["t"] for r in upserts.touch(table, batch, "k", "t").collect()} == {"a": at(0), "b": at(2)}
    keys = spark.createDataFrame([("a",), ("z",), ("z",)], "k string")
    assert {r["k"]: r["n"] for r in upserts.increment(table, keys, "k", "n").collect()} == {"a": 6, "b": 6, "z": 2}
    after, changed = upserts.conditional(table, F.col("t").isNull(), {"n": F.lit(0)})
    assert {r["k"]: r["n"] for r in after.collect()} == {"a": 5, "b": 0} and [r["k"] for r in changed.collect()] == ["b"]
    assert [r["k"] for r in upserts.pruned(table, "t", at(1)).collect()] == ["b"]
    assert [r["k"] for r in upserts.without(table, keys, "k").collect()] == ["b"]
    warm = spark.createDataFrame([("n1", "x"), ("n1", "y"), ("n2", "x")], "node string, s string")
    assert sorted(map(tuple, upserts.replaced_members(warm, spark.createDataFrame([("n1", "z")], "node string, s string"), "node").collect())) == [("n1", "z"), ("n2", "x")]


def test_pages_and_caps(spark):
    df = spark.range(10)
    assert [r["id"] for r in paging.page(df, ["id"], 3, 2).collect()] == [2, 3, 4, 5]
    assert paging.page(df, ["id"], 0, -5).count() == 2 and paging.page(spark.range(1000), ["id"], 9999).count() == 201
    assert [r["id"] for r in paging.after(df, "id", None, 2).collect()] == [0, 1]
    assert len(paging.capped(df, 10)) == 10 and paging.truncated(df, 4)[1] and not paging.truncated(df, 10)[1]
    with pytest.raises(paging.ResultTooLarge):
        paging.capped(df, 9)
    lru = spark.createDataFrame([("a", 3, False, True), ("b", 1, True, True), ("c", 2, False, True), ("d", 0, False, False)], "k string, t int, busy boolean, live boolean")
    assert [r["k"] for r in paging.least_recent(lru, "t", "busy", "live", 2, "k").collect()] == ["c", "a"]


def test_metrics_text(spark):
    lines = ['up{job="x",le="0.5"} 1', "up 2.5e3", "bad line here now", "inf_metric +Inf", "nan_metric NaN", 'h_bucket{le="1"} 3', 'h_bucket{le="+Inf"} 4', "# HELP up", 'h_count{a="b"} 4', ""]
    s = prometheus.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {(r["name"], tuple(sorted(r["labels"].items())), r["value"]) for r in s.collect()} == {
        ("up", (("job", "x"), ("le", "0.5")), 1.0), ("up", (), 2500.0), ("inf_metric", (), float("inf")), ("h_bucket", (("le", "1"),), 3.0), ("h_bucket", (("le", "+Inf"),), 4.0), ("h_count", (("a", "b"),), 4.0),
    }
    assert one(prometheus.value(s, "up", {"job": "x"})) == 1.0 and one(prometheus.value(s, "none", default=7.0)) == 7.0
    assert [r[0] for r in prometheus.label_values(s, "up", "job").collect()] == ["x"]
    b = prometheus.buckets(s, "h")
    assert one(b.select(histograms.percentile_cumulative(F.col("buckets"), 50))) == pytest.approx(2 / 3)
    diff = joins.aligned_difference(F.col("buckets"), F.expr("array(struct(1.0D AS le, 2.0D AS cum), struct(9.0D AS le, 1.0D AS cum))"))
    assert [tuple(x) for x in one(b.select(diff))] == [(1.0, 1.0), (float("inf"), 4.0)]


def test_generators(spark):
    assert [r["x"] for r in generators.sequence(spark, 3, 5).collect()] == [3, 4, 5]
    drawn = generators.zipf(spark, 50, 5000, 1.0).groupBy("rank").count().orderBy(F.desc("count")).collect()
    assert drawn[0]["rank"] == 1 and all(1 <= r["rank"] <= 50 for r in drawn)
