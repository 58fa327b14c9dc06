"""Tenant sessions, versioned datasets and processors."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.streaming import processors, sinks
from quillon.tenant import errors, ids, splitter
from quillon.tenant.session import TenantSession
from quillon.versions.store import Absent, Refused, Store, Superseded, replay, same


@pytest.fixture(scope="module")
def tenant(spark):
    return TenantSession(spark, "acme", {"t": spark.range(5), "u": spark.createDataFrame([(1, "a")], "id long, s string")})


def test_queries_run(tenant):
    assert tenant.rows("SELECT count(*) FROM t JOIN u USING (id)")[0][0] == 1
    assert tenant.rows("WITH x AS (SELECT id FROM t) SELECT sum(id) FROM x WHERE id > ?", [2])[0][0] == 7
    assert tenant.rows("SELECT django_date_trunc('year', '2024-05-06', NULL, NULL)")[0][0] == "2024-01-01"
    assert tenant.rows("VALUES (1)")[0][0] == 1 and "Project" in tenant.rows("EXPLAIN SELECT id + 1 FROM t")[0][0]
    assert [r[0] for s in tenant.script("SELECT 1; -- a;b\nSELECT 'c;d'; ;") for r in s] == [1, "c;d"]
    assert tenant.describe("SELECT s, id FROM u WHERE s = ? AND s <> '?'") == {"columns": [("s", "string"), ("id", "bigint")], "parameters": 1, "explain": False, "readonly": True}


@pytest.mark.parametrize(
    "statement, code",
    [
        ("INSERT INTO t VALUES (1)", "FILO_READONLY"), ("/* x */ DROP TABLE t", "FILO_READONLY"), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FILO_READONLY"), ("CREATE VIEW v AS SELECT 1", "FILO_READONLY"),
        ("SET a = b", "FILO_BLOCKED"), ("ADD JAR x", "FILO_BLOCKED"), ("VACUUM", "FILO_BLOCKED"), ("PRAGMA x = 1", "FILO_BLOCKED"), ("SELECT * FROM parquet.`/etc`", "FILO_BLOCKED"), ("SELECT * FROM other", "FILO_BLOCKED"),
        ("SELECT (SELECT max(id) FROM default.t)", "FILO_BLOCKED"), ("SELECT java_method('java.lang.System', 'exit', 1)", "FILO_BLOCKED"), ("SELECT nope FROM t", "SQLITE_ERROR"), ("SELECT FROM WHERE", "SQLITE_ERROR"), ("EXPLAIN DROP VIEW t", "FILO_READONLY"),
        ("SELECT * FROM IDENTIFIER('other')", "FILO_BLOCKED"), ("SELECT TRANSFORM(id) USING 'cat' AS x FROM t", "FILO_READONLY"), ("SELECT input_file_name() FROM t", "FILO_BLOCKED"), ("SELECT _metadata.file_path FROM t", "FILO_BLOCKED"), ("FROM t INSERT INTO u SELECT id, 'a'", "FILO_READONLY"),
    ],
)
def test_what_is_refused(tenant, statement, code):
    with pytest.raises(errors.TenantError) as e:
        tenant.rows(statement)
    assert e.value.code == code


def test_scripts_are_refused_whole(tenant):
    with pytest.raises(errors.TenantError):
        tenant.script("SELECT 1; DROP TABLE t")


def test_limits(spark):
    t = TenantSession(spark, "acme", {"t": spark.range(5)}, row_cap=4, deadline_s=1.0)
    with pytest.raises(errors.TenantError, match="4 rows"):
        t.rows("SELECT * FROM t")
    with pytest.raises(errors.TenantError) as e:
        t.rows("SELECT count(*) FROM range(1000000) a, range(100000000) b WHERE a.id + b.id = 7")
    assert e.value.code == "FILO_QUERY_TIMEOUT"
    with pytest.raises(errors.TenantError):
        TenantSession(spark, "acme", {}, status="suspended")


def test_tenants_do_not_see_each_other(spark, tenant):
    other = TenantSession(spark, "b", {"secret": spark.range(1)})
    assert other.rows("SELECT count(*) FROM secret")[0][0] == 1
    with pytest.raises(errors.TenantError):
        tenant.rows("SELECT * FROM secret")


def test_hosts():
    assert ids.for_host("Acme.db.example.com:8080", "db.example.com") == "acme"
    for bad in (None, "", "db.example.com", "a.b.db.example.com", "acme.db.example.com.evil.org", "-a.db.example.com", "xdb.example.com"):
        with pytest.raises(ids.UnknownTenant):
            ids.for_host(bad, "db.example.com")


@given(st.lists(st.sampled_from(["SELECT 1", "'a;''b'", '"c;d"', "`e;f`", "[g;h]", "-- x;y\n", "/* z;z */", "1 + 2"]), min_size=1, max_size=6))
def test_statements_split_at_real_ends_only(parts):
    assert splitter.split(" ".join(parts) + ";" + parts[0]) == [s for s in (" ".join(parts).strip(), parts[0].strip()) if splitter.bare(s)]


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_versions(spark, store):
    with pytest.raises(Absent):
        store.current("a")
    assert store.publish("a", {"t": spark.range(3)}, 1) == 1 and store.inspect("a") == {"t": 3}
    kept = store.snapshot("a", "auto")
    assert kept.endswith("-auto") and store.read_if_changed("a", 1) is None
    assert store.publish("a", {"t": spark.range(5)}, 1, 1) == 2 and store.read_if_changed("a", 1)[0] == 2
    with pytest.raises(Superseded):
        store.publish("a", {"t": spark.range(9)}, 1, 1)
    assert store.snapshots("a") == [kept] and store.read_snapshot("a", kept)["t"].count() == 3
    assert store.restore("a", kept) == 3 and store.inspect("a") == {"t": 3}
    assert store.drill("a", kept, 1) == "ok" and store.drill("a", kept, 2) == "schema_mismatch" and store.drill("a", "x", 1) == "absent"
    objects, size = store.usage()
    assert objects > 3 and size > 0


def test_restoring_across_schemas_needs_force(spark, store):
    store.publish("a", {"t": spark.range(1)}, 1)
    kept = store.snapshot("a")
    store.publish("a", {"t": spark.range(2)}, 2)
    with pytest.raises(Refused):
        store.restore("a", kept)
    assert store.restore("a", kept, force=True) == 3
    with pytest.raises(Refused):
        store.revert("a", store.current("a")["version"], 1, written_after=True)
    with pytest.raises(Refused):
        store.drop_version("a", store.current("a")["version"])


def test_forks_and_purges_take_exact_names(spark, store):
    store.publish("acme", {"t": spark.range(1)}, 1)
    store.publish("acme2", {"t": spark.range(2)}, 1)
    store.fork("acme2", "copy")
    for source, target in (("acme", "copy"), ("none", "x")):
        with pytest.raises((Refused, Absent)):
            store.fork(source, target)
    assert store.purge("acme") and not store.exists("acme") and store.inspect("acme2") == {"t": 2}
    with pytest.raises(Refused):
        store.purge("acme2/data")
    assert same(store.tables("acme2"), store.tables("copy")) == []


def test_replay_publishes_step_by_step(spark, store):
    store.publish("a", {"t": spark.range(3)}, 1)
    rename = lambda t: {"t": t["t"].withColumnRenamed("id", "k")}

    def fail(_):
        raise RuntimeError("broken step")

    with pytest.raises(RuntimeError):
        replay(store, "a", [(1, fail), (2, rename), (3, fail)])
    assert store.current("a")["schema_version"] == 2 and store.tables("a")["t"].columns == ["k"]
    with pytest.raises(Refused):
        replay(store, "a", [(3, lambda t: t)], {}, {3: "evil"})
    double = lambda t: {"t": t["t"].withColumn("k", F.col("k") * 2)}
    assert replay(store, "a", [(3, lambda t: t)], {"double": double}, {3: "double"}) == 3
    assert sorted(r["k"] for r in store.tables("a")["t"].collect()) == [0, 2, 4]
    with pytest.raises(Refused):
        replay(store, "a", [(4, lambda t: None)])


def run(spark, processor, rows, schema):
    df = spark.createDataFrame([("k", i, *r) for i, r in enumerate(rows)], f"key string, seq int, {schema}")
    n = len(processors._fields(processor.verdict))
    return [tuple(r)[-n:] for r in processors.over_table(df, "key", ["seq"], processor).orderBy("seq").collect()]


def test_fixed_windows_start_with_the_first_hit(spark):
    assert run(spark, processors.FixedWindow(2, 10), [(5,), (6,), (14,), (15,), (16,), (24,), (25,)], "at long") == [(True,), (True,), (False,), (True,), (True,), (False,), (True,)]


def test_token_bucket(spark):
    assert run(spark, processors.TokenBucket(0.5, 2.0), [(0,), (0,), (0,), (2,), (3,), (4,)], "at long") == [(True,), (True,), (False,), (True,), (False,), (True,)]
    assert run(spark, processors.TokenBucket(1.0), [(0,)] * 11, "at long") == [(True,)] * 10 + [(False,)]


def test_log_apply(spark):
    rows = [(1, 0, 7, 5, 10), (1, 0, 7, 0, 10), (1, 0, 7, 10, 5), (1, 0, 7, 10, 5), (0, 0, 7, 15, 5), (1, 0, 8, 15, 5), (1, 0, 8, 0, 4), (2, 0, 8, 0, 3), (2, 1, 8, 3, 3), (2, 1, 8, 0, 6), (2, 0, 8, 6, 1)]
    want = [("mismatch", 0), ("reset", 10), ("append", 15), ("mismatch", 15), ("stale_epoch", 0), ("mismatch", 0), ("reset", 4), ("reset", 3), ("mismatch", 0), ("reset", 6), ("stale_gen", 0)]
    assert run(spark, processors.LogApply(), rows, "epoch long, gen long, salt long, pos long, size long") == want


def test_quorum(spark):
    assert run(spark, processors.Quorum(3, 2), [("a", True), ("a", True), ("b", False), ("c", True)], "node string, ok boolean") == [("pending",), ("pending",), ("pending",), ("reached",)]
    assert run(spark, processors.Quorum(3, 2), [("a", False), ("b", False)], "node string, ok boolean") == [("pending",), ("impossible",)]
    with pytest.raises(ValueError):
        processors.Quorum(2, 2)


def test_transactions(spark):
    rows = [("other",), ("begin",), ("other",), ("commit",), ("other",), ("begin",), ("rollback",)]
    assert run(spark, processors.Transactions(), rows, "kind string") == [(1, True), (2, False), (2, False), (2, False), (3, True), (4, False), (4, False)]


def test_a_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "key string, seq int, at long"
    source, out = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    stream = processors.over_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "key", ["seq"], processors.FixedWindow(2, 10))
    for rows in ([[("a", 0, 0), ("b", 1, 0)], [("a", 2, 1)], [("a", 3, 2), ("a", 4, 10)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r["seq"]: r["allowed"] for r in out} == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_write_behind_keeps_the_newest(spark, tmp_path, store):
    from quillon.operators import upserts

    t0 = dt.datetime(2024, 1, 1)
    store.publish("d", {"s": spark.createDataFrame([("a", t0, 1)], "id string, at timestamp_ntz, n int")}, 1)
    source = str(tmp_path / "in")
    rows = [("a", t0 - dt.timedelta(1)), ("b", t0), ("b", t0 + dt.timedelta(1))]
    spark.createDataFrame(rows, "id string, at timestamp_ntz").write.parquet(source)
    stream = spark.readStream.schema("id string, at timestamp_ntz").parquet(source)
    upsert = lambda table, batch: upserts.newest_wins(table, batch, "id", "at", {"n": F.lit(0)})
    sinks.write_behind(stream, "id", "at", store, "d", "s", upsert, str(tmp_path / "c")).awaitTermination(120)
    assert {(r["id"], r["at"], r["n"]) for r in store.tables("d")["s"].collect()} == {("a", t0, 1), ("b", t0 + dt.timedelta(1), 0)}


def test_shipping_plan(spark):
    p = spark.createDataFrame([("a", 1, 7, 100), ("b", 1, 7, 100), ("c", 2, 7, 100), ("d", 1, 7, 50), ("e", 1, 7, 10)], "k string, gen int, salt int, extent int")
    f = spark.createDataFrame([("a", 1, 7, 100), ("b", 1, 7, 30), ("c", 1, 7, 100), ("e", 1, 7, 90)], "k string, gen int, salt int, pos int")
    got = {r["k"]: (r["action"], r["start"], r["bytes"]) for r in sinks.shipping(p, f, "k", 60).collect()}
    assert got == {"a": ("nothing", 100, 0), "b": ("append", 30, 60), "c": ("reset", 0, 60), "d": ("reset", 0, 50), "e": ("reset", 0, 10)}


def test_repeats_within_the_horizon_drop_out(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0), ("a", t0), ("a", t0 + dt.timedelta(minutes=1))]
    spark.createDataFrame(rows, "k string, at timestamp").write.parquet(str(tmp_path / "in"))
    out = []
    stream = sinks.distinct_windows(spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in")), ["k"], "at", "1 hour")
    stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert len(out) == 2
