"""Captured statements, row changes, replica choice, small formats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import library
from quillon.operators import dml
from quillon.plans import reports
from quillon.tenant import capture, errors
from quillon.tenant.session import TenantSession


def test_marks_and_reads():
    assert [capture.mark(s) for s in ("BEGIN IMMEDIATE", "-- x\ncommit;", "END", "ROLLBACK", "ROLLBACK TO s", "SAVEPOINT s", "", "SELECT 1")] == ["begin", "commit", "commit", "rollback", "other", "other", "other", "other"]
    assert capture.replayable(["SELECT 1", "PRAGMA table_info(t)", "PRAGMA foreign_keys = ON", "WITH x AS (SELECT 1) DELETE FROM t", "UPDATE t SET a = 1"]) == ["PRAGMA foreign_keys = ON", "WITH x AS (SELECT 1) DELETE FROM t", "UPDATE t SET a = 1"]


def test_data_statements():
    yes = ["INSERT INTO t VALUES (1)", "UPDATE t SET a = 'select'", "/* c */ DELETE FROM t", "INSERT INTO t VALUES ('select')"]
    no = ["INSERT INTO new__t SELECT * FROM t", 'INSERT INTO "django_migrations" VALUES (1)', "CREATE TABLE t (a)", "SELECT 1"]
    assert all(map(capture.data_statement, yes)) and not any(map(capture.data_statement, no))


def test_row_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    after, new = dml.insert(t, spark.createDataFrame([(3,)], "k long"))
    assert rows(after) == [(1, "a"), (2, None), (3, None)] and rows(new) == [(3, None)] and after.schema == t.schema
    after, changed = dml.update(t, F.col("v") == "a", {"k": F.lit(9)})
    assert rows(after) == [(2, None), (9, "a")] and rows(changed) == [(9, "a")]
    after, gone = dml.delete(t, F.col("v") == "a")
    assert rows(after) == [(2, None)] and rows(gone) == [(1, "a")]
    after, new = dml.replace(t, spark.createDataFrame([(1, "z"), (5, "y")], "k int, v string"), ["k"])
    assert rows(after) == [(1, "z"), (2, None), (5, "y")]


def test_best_copies(spark):
    stored = spark.createDataFrame([("a", 1, 1, 10), ("b", 2, 0, 0), ("c", 1, 1, 1)], "shard_id string, epoch int, gen int, pos int")
    offers = spark.createDataFrame([("a", "n1", 1, 1, 20), ("a", "me", 1, 1, 20), ("b", "n1", 1, 9, 99), ("c", "n2", 1, 2, 0), ("c", "me", 1, 1, 5)], "shard_id string, node string, epoch int, gen int, pos int")
    assert {r["shard_id"]: r["source"] for r in reports.best_copy(stored, offers, "me").collect()} == {"a": "me", "b": "object", "c": "n2"}
    lit = F.lit
    assert tuple(spark.range(1).select(reports.still_valid(lit(1), lit(2), lit(1), lit(0)), reports.still_valid(lit(1), lit(1), lit(1), lit(1)), reports.still_valid(lit(1), lit(1), lit(2), lit(1))).first()) == ("object_moved", "object_advanced", "ok")


def test_reports(spark):
    t0 = dt.datetime(2024, 1, 1)
    shards = spark.createDataFrame([("a", t0, None), ("b", t0, t0), ("c", None, None), ("d", t0 + dt.timedelta(hours=1), t0)], "shard_id string, last_active_at timestamp_ntz, last_flushed_at timestamp_ntz")
    assert tuple(reports.dirty_age(shards, F.lit(t0 + dt.timedelta(hours=2))).first()) == (2, 7200.0)
    txns = spark.createDataFrame([("pay", t0, 1_000_000), ("pay", t0, 3_000_000), ("new", t0 + dt.timedelta(seconds=59), 1_000_000)], "kind string, began timestamp_ntz, us long")
    got = {r["kind"]: (r["n"], r["p50"], r["max"], r["per_minute"]) for r in reports.transaction_summary(txns).collect()}
    assert got == {"pay": (2, 2e6, 3_000_000, 2.0), "new": (1, 1e6, 1_000_000, 1.0)}
    moves = spark.createDataFrame([("a", "n1"), ("b", "n2")], "shard_id string, to_node string")
    warm = spark.createDataFrame([("a", "n1"), ("b", "n1")], "shard_id string, node_key string")
    assert {r["shard_id"]: r["hit"] for r in reports.affinity(moves, warm).collect()} == {"a": True, "b": False}
    entries = spark.createDataFrame([(1, t0, "x"), (2, t0, "y"), (3, t0 + dt.timedelta(1), "x")], "id int, at timestamp_ntz, actor string")
    assert [r["id"] for r in reports.audit(entries, 5, actor="x").collect()] == [3, 1]
    nodes = spark.createDataFrame([("n1", t0, "h"), ("n2", t0 - dt.timedelta(1), "h"), ("n3", t0, None), ("me", t0, "h")], "node_key string, last_seen_at timestamp_ntz, address string")
    assert [r["node_key"] for r in reports.live_members(nodes, F.lit(t0), 60, "me").collect()] == ["n1"]
    changed = spark.createDataFrame([("a", t0), ("b", t0 - dt.timedelta(1))], "k string, updated_at timestamp_ntz")
    assert reports.refreshed(changed.filter("k = 'a'"), changed, F.lit(t0)).count() == 1


def test_small_formats(spark):
    library.register(spark)
    one = lambda e: spark.sql(f"SELECT {e} AS x").first()["x"]
    assert one("sqlite_quote('it''s')") == "'it''s'" and one("sqlite_quote(NULL)") == "NULL"
    assert one("sqlite_strftime('%Y/%m/%d %H:%M:%S %j %w %f %s', TIMESTAMP_NTZ'2024-02-03 04:05:06.789')") == "2024/02/03 04:05:06 034 6 06.789 1706933106"
    assert isinstance(one("sqlite_random()"), int)


def test_introspection(spark):
    t = TenantSession(spark, "acme", {"t": spark.range(3)}, row_cap=2)
    assert t.tables() == {"t": [("id", "bigint")]} and t.rows("DESCRIBE t")[0][0] == "id"
    for s in ("SHOW TABLES", "SHOW DATABASES", "DESCRIBE default.t", "DESCRIBE DATABASE default"):
        with pytest.raises(errors.TenantError):
            t.rows(s)
    with pytest.raises(errors.TenantError):
        list(t.stream("SELECT * FROM t"))
