"""Further registered queries: sinks, stores, tenant sessions, captured statements, gauges, single rules as rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.functions.clock import micros
from quillon.operators import dml, histograms, joins, paging, upserts, windows
from quillon.plans import fleet, policy, reports
from quillon.queries import DIRECTORY, ORACLES, directory, in_sql, query
from quillon.sources import prometheus
from quillon.tenant import capture, errors, ids, splitter
from quillon.tenant.session import TenantSession
from quillon.versions.store import Absent, Refused, Store, Superseded, replay, same


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    return f"{root.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"


# --- state machines in SQL ------------------------------------------------------------------------

ORACLES["transactions"] = """
WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'begin' WHEN 'purchase' THEN 'commit' ELSE 'other' END AS kind FROM events),
o AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'other' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'commit') = 'begin' AS open FROM k)
SELECT user_id, event_id, kind, CAST(sum(CASE WHEN kind = 'begin' OR (kind = 'other' AND NOT open) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS txn, kind = 'other' AND NOT open AS autocommit FROM o"""

ORACLES["quorum_counts"] = """
WITH a AS (SELECT user_id AS write, event_id, event_type AS node, event_id % 4 <> 0 AS ok FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY write, node, ok ORDER BY event_id) = 1 AS fresh FROM a),
c AS (SELECT *, sum(CASE WHEN ok AND fresh THEN 1 ELSE 0 END) OVER w AS acked, sum(CASE WHEN NOT ok AND fresh THEN 1 ELSE 0 END) OVER w AS refused FROM f WINDOW w AS (PARTITION BY write ORDER BY event_id))
SELECT write, event_id, node, ok, CASE WHEN acked >= 2 THEN 'reached' WHEN 4 - refused < 2 THEN 'impossible' ELSE 'pending' END AS outcome FROM c"""

ORACLES["fixed_window_limiter"] = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, event_id, tm, i, tm AS began, 1 AS hits, true AS allowed FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.tm, e.i, CASE WHEN e.tm - s.began >= 3600000000 THEN e.tm ELSE s.began END, CASE WHEN e.tm - s.began >= 3600000000 THEN 1 ELSE s.hits + 1 END, e.tm - s.began >= 3600000000 OR s.hits < 2 FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, tm AS "at", allowed FROM s"""

ORACLES["token_bucket_limiter"] = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, event_id, tm, i, 1.0::DOUBLE AS tokens, true AS allowed FROM e WHERE i = 1 UNION ALL
SELECT user_id, event_id, tm, i, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM (SELECT e.user_id, e.event_id, e.tm, e.i, least(2.0::DOUBLE, s.tokens + greatest(0, e.tm - s.tm)::DOUBLE * (1.0::DOUBLE / 3600000000.0::DOUBLE)) AS t FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, event_id, tm AS "at", allowed FROM s"""


# --- sinks as projections -------------------------------------------------------------------------


@query(f"WITH d AS ({DIRECTORY}), b AS (SELECT o_custkey AS shard_id, max(o_orderdate) AS ts FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) SELECT shard_id, status, greatest(last_flushed_at, b.ts) AS last_flushed_at FROM d LEFT JOIN b USING (shard_id)")
def touch_known(spark, t):
    batch = t("orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("shard_id"), F.col("o_orderdate").alias("last_flushed_at"))
    return upserts.touch(directory(t), batch, "shard_id", "last_flushed_at").select("shard_id", "status", "last_flushed_at")


@query("SELECT k, CAST(coalesce(v, 1) + CASE WHEN g AND v IS NOT NULL THEN 1 WHEN g THEN 1 ELSE 0 END AS INTEGER) AS version FROM (SELECT coalesce(s_suppkey, c_custkey) AS k, 1 AS one, CASE WHEN s_suppkey IS NOT NULL THEN 1 END AS v, c_custkey IS NOT NULL AS g FROM supplier FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) c ON c_custkey = s_suppkey)")
def bump_versions(spark, t):
    table = t("supplier").select(F.col("s_suppkey").alias("k"), F.lit(1).alias("version"))
    return upserts.increment(table, t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k", "version")


@query("SELECT n_regionkey AS node, n_nationkey AS shard FROM nation WHERE n_regionkey NOT IN (1, 2) UNION ALL SELECT 1, 100 + r_regionkey FROM region")
def publish_members(spark, t):
    table = t("nation").select(F.col("n_regionkey").cast("bigint").alias("node"), F.col("n_nationkey").cast("bigint").alias("shard"))
    return upserts.replaced_members(table, t("region").select(F.lit(1).cast("bigint").alias("node"), (F.col("r_regionkey") + 100).cast("bigint").alias("shard")), "node", [1, 2])


@query("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND ts < TIMESTAMP '2024-01-10') AND NOT ts < TIMESTAMP '2024-01-03'")
def prune_by_age(spark, t):
    when = lambda s: __import__("datetime").datetime.fromisoformat(s)
    return upserts.pruned(t("events").select("event_id", "event_type", "ts"), "ts", when("2024-01-10"), "event_type", "click", when("2024-01-03")).select("event_id")


STATES = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END"


@query(f"SELECT o_orderkey, CASE WHEN s = 'pending' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE s END AS state FROM (SELECT o_orderkey, o_orderdate, {STATES} AS s FROM orders) WHERE NOT (s IN ('done', 'failed') AND o_orderdate < TIMESTAMP '1996-01-01')")
def prune_terminal(spark, t):
    cut = __import__("datetime").datetime(1996, 1, 1)
    jobs = t("orders").select("o_orderkey", "o_orderdate", F.expr(STATES).alias("state"))
    return upserts.expired(upserts.pruned_terminal(jobs, "o_orderdate", cut, ["done", "failed"]), "o_orderdate", cut).select("o_orderkey", "state")


@query(f"WITH d AS ({DIRECTORY}), g AS (SELECT DISTINCT s_suppkey * 3 AS k FROM supplier) SELECT coalesce(d.shard_id, k) AS shard_id, CASE WHEN k IS NOT NULL THEN 'deleted' ELSE status END AS status FROM d FULL JOIN g ON k = d.shard_id")
def tombstones(spark, t):
    gone = t("supplier").select((F.col("s_suppkey") * 3).alias("shard_id"))
    return upserts.tombstoned(directory(t).select("shard_id", "status"), gone, "shard_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def hard_delete(spark, t):
    return upserts.without(t("customer").select("c_custkey"), t("supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def replace_rows(spark, t):
    return dml.replace(t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), ["k"])[0]


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, NULL FROM region")
def append_rows(spark, t):
    return dml.insert(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), t("region").select(F.col("r_regionkey").alias("k")))[0]


# --- versioned datasets ---------------------------------------------------------------------------


@query("""SELECT 'now' AS what, CAST(count(*) AS BIGINT) AS n FROM supplier UNION ALL SELECT 'snapshot', count(*) FROM customer UNION ALL SELECT 'restored', count(*) FROM customer UNION ALL SELECT 'snapshots', 1
UNION ALL SELECT 'unchanged', 1 UNION ALL SELECT 'fork', count(*) FROM customer UNION ALL SELECT 'differing', 0 UNION ALL SELECT 'manifest', 3 UNION ALL SELECT 'exported', count(*) FROM customer""")
def store_life(spark, t):
    store = Store(spark, scratch(spark, "store"))
    table = lambda name, key: {"t": t(name).select(F.col(key).alias("k"))}
    store.publish("a", table("customer", "c_custkey"), 1)
    kept = store.snapshot("a", "auto")
    store.publish("a", table("supplier", "s_suppkey"), 1)
    out = [("now", store.inspect("a")["t"]), ("snapshot", store.read_snapshot("a", kept)["t"].count()), ("snapshots", len(store.snapshots("a"))), ("unchanged", int(store.read_if_changed("a", 2) is None))]
    out.append(("manifest", store.restore("a", kept)))
    out.append(("restored", store.tables("a")["t"].count()))
    store.fork("a", "b")
    out += [("fork", store.inspect("b")["t"]), ("differing", len(same(store.tables("a"), store.tables("b"))))]
    folder = scratch(spark, "export")
    store.export("a", folder)
    out.append(("exported", spark.read.parquet(f"{folder}/t").count()))
    return spark.createDataFrame(out, "what string, n bigint")


def _outcome(f) -> str:
    try:
        return str(f())
    except (Absent, Refused, Superseded) as e:
        return type(e).__name__


@query("""SELECT * FROM (VALUES ('lost race', 'Superseded'), ('other schema', 'Refused'), ('forced', '3'), ('drill', 'ok'), ('drill schema', 'schema_mismatch'), ('drill absent', 'absent'), ('drill sentinel', 'sentinel'), ('drop current', 'Refused'), ('revert', 'Refused'),
('fork over', 'Refused'), ('no dataset', 'Absent'), ('purge', 'True'), ('purge path', 'Refused'), ('no label', 'Refused')) v(what, outcome)""")
def store_refusals(spark, t):
    store = Store(spark, scratch(spark, "store"))
    one = {"t": t("region").select("r_regionkey"), "none": t("region").filter("r_regionkey < 0")}
    store.publish("a", one, 1)
    kept = store.snapshot("a")
    store.publish("a", one, 2)
    store.publish("b", one, 1)
    steps = {
        "lost race": lambda: store.publish("a", one, 2, 1), "other schema": lambda: store.restore("a", kept), "forced": lambda: store.restore("a", kept, force=True), "drill": lambda: store.drill("a", kept, 1, "t"), "drill schema": lambda: store.drill("a", kept, 2),
        "drill absent": lambda: store.drill("a", "x", 1), "drill sentinel": lambda: store.drill("a", kept, 1, "none"), "drop current": lambda: store.drop_version("a", store.current("a")["version"]), "revert": lambda: store.revert("a", store.current("a")["version"], 1, written_after=True),
        "fork over": lambda: store.fork("a", "b"), "no dataset": lambda: store.current("z"), "purge": lambda: store.purge("b"), "purge path": lambda: store.purge("a/data"), "no label": lambda: store.snapshot("a", "A b"),
    }
    return spark.createDataFrame([(what, _outcome(f)) for what, f in steps.items()], "what string, outcome string")


@query("SELECT n_nationkey * 2 AS k, upper(n_name) AS name FROM nation WHERE n_regionkey <> 1")
def replayed_steps(spark, t):
    store = Store(spark, scratch(spark, "store"))
    store.publish("a", {"t": t("nation").select("n_nationkey", "n_name", "n_regionkey")}, 1)
    double = lambda tables: {"t": tables["t"].withColumn("k", F.col("k") * 2)}
    steps = [(1, lambda tables: {}), (2, lambda tables: {"t": tables["t"].filter("n_regionkey <> 1").withColumnRenamed("n_nationkey", "k")}), (3, lambda tables: {"t": tables["t"].select("k", F.upper("n_name").alias("name"))})]
    replay(store, "a", steps, {"double": double}, {2: "double"})
    return store.tables("a")["t"]


# --- tenant sessions ------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(props, '[0-9]5') THEN 1 ELSE 0 END) AS BIGINT) AS fives, min(lpad(event_type, 12, '.')) AS padded FROM events WHERE event_type ILIKE '%C%' GROUP BY 1")
def tenant_select(spark, t):
    session = TenantSession(spark, "acme", {"events": t("events")})
    return session.query("""SELECT "event_type", count(*) AS n, sum(CASE WHEN props REGEXP '[0-9]5' THEN 1 ELSE 0 END) AS fives, min(LPAD(event_type, 12, '.')) AS padded FROM [events] WHERE event_type LIKE '%C%' GROUP BY 1""")


REFUSALS = [
    ("INSERT INTO r VALUES (1)", "FILO_READONLY"), ("DROP TABLE r", "FILO_READONLY"), ("/* x */ WITH a AS (SELECT 1) INSERT INTO r SELECT * FROM a", "FILO_READONLY"), ("PRAGMA writable_schema = 1", "FILO_BLOCKED"), ("ATTACH x AS y", "FILO_BLOCKED"), ("SET a = b", "FILO_BLOCKED"),
    ("SELECT * FROM other", "FILO_BLOCKED"), ("SELECT * FROM parquet.`/etc`", "FILO_BLOCKED"), ("SELECT nope FROM r", "SQLITE_ERROR"), ("SELECT FROM WHERE", "SQLITE_ERROR"), ("EXPLAIN DROP TABLE r", "FILO_READONLY"), ("SELECT reflect('java.lang.System', 'exit')", "FILO_BLOCKED"),
    ("SELECT * FROM r", "FILO_RESULT_TOO_LARGE"), ("SELECT count(*) FROM r", "ok"), ("SELECT STDDEV_POP(r_name) FROM r", "SQLITE_ERROR"), ("CREATE VIEW v AS SELECT 1", "FILO_READONLY"),
]


@query("SELECT * FROM (VALUES " + ", ".join("('" + s.replace("'", "''") + f"', '{c}')" for s, c in REFUSALS) + ") v(statement, code)")
def tenant_refusals(spark, t):
    session = TenantSession(spark, "acme", {"r": t("region")}, row_cap=3)

    def code(statement: str) -> str:
        try:
            session.rows(statement)
        except errors.TenantError as e:
            return e.code if not e.code.startswith("SQLITE_") else "SQLITE_ERROR"
        return "ok"

    return spark.createDataFrame([(s, code(s)) for s, _ in REFUSALS], "statement string, code string")


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS name, CASE WHEN n_regionkey = 2 THEN 1 END AS mark FROM nation WHERE n_regionkey <> 3 AND n_nationkey > 1 UNION ALL SELECT 100 + r_regionkey, r_name, NULL FROM region UNION ALL SELECT 1, 'replaced', NULL""")
def tenant_writes(spark, t):
    session = TenantSession(spark, "acme", {"n": t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r")), "region": t("region")}, staging=scratch(spark, "staging"))
    for statement in (
        "ALTER TABLE n ADD COLUMN mark INTEGER", "UPDATE n SET name = 'two', mark = 1 WHERE r = 2", "DELETE FROM n WHERE r = 3 OR id < 1", "INSERT INTO n (id, name) SELECT 100 + r_regionkey, r_name FROM region", "INSERT OR REPLACE INTO n (id, name) VALUES (1, 'replaced')", "ALTER TABLE n DROP COLUMN r",
    ):
        session.execute(statement)
    return session.tables_now()["n"].select("id", "name", F.col("mark").cast("int").alias("mark"))


@query("SELECT n_nationkey AS id, n_nationkey + 1 AS next, CAST((SELECT count(*) FROM nation WHERE n_regionkey = 1) AS BIGINT) AS affected FROM nation WHERE n_regionkey = 1")
def tenant_returning(spark, t):
    session = TenantSession(spark, "acme", {"n": t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("r"))}, staging=scratch(spark, "staging"))
    done = session.execute("DELETE FROM n WHERE r = ? RETURNING id, id + 1 AS next", [1])
    return spark.createDataFrame([(*row, done.affected) for row in done.rows], "id bigint, next bigint, affected bigint")


SCRIPT = "SELECT 1; -- a;b\nSELECT 'c;d'; /* x;y */ ; UPDATE t SET a = \"q;r\" WHERE b = ? AND c = '?'; begin;"


@query("SELECT * FROM (VALUES (0, 'SELECT', 0, 'other', true), (1, 'SELECT', 0, 'other', true), (2, 'UPDATE', 1, 'other', false), (3, 'BEGIN', 0, 'begin', false)) v(place, word, parameters, mark, pure_read)")
def script_statements(spark, t):
    rows = [(i, splitter.leading_word(s), splitter.parameters(s), capture.mark(s), capture.pure_read(s)) for i, s in enumerate(splitter.split(SCRIPT))]
    return spark.createDataFrame(rows, "place int, word string, parameters int, mark string, pure_read boolean")


@query("SELECT DISTINCT lower(replace(c_mktsegment, ' ', '-')) || '.db.example.com:80' AS host, lower(replace(c_mktsegment, ' ', '-')) AS tenant FROM customer UNION ALL SELECT DISTINCT c_mktsegment || '.evil.org', 'refused' FROM customer")
def hosts_of_tenants(spark, t):
    names = [r["c_mktsegment"] for r in t("customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(50).collect()]

    def tenant(host: str) -> str:
        try:
            return ids.for_host(host, "db.example.com")
        except ids.UnknownTenant:
            return "refused"

    given = [n.lower().replace(" ", "-") + ".db.example.com:80" for n in names] + [n + ".evil.org" for n in names]
    return spark.createDataFrame([(h, tenant(h)) for h in given], "host string, tenant string")


# --- single rules as rows -------------------------------------------------------------------------


@query("SELECT CAST(max(p_partkey) + 1 AS BIGINT) AS next FROM part")
def next_version(spark, t):
    return fleet.next_version(t("part").select(F.col("p_partkey").alias("version")))


@query(f"WITH d AS ({DIRECTORY}) SELECT shard_id, token_version FROM d WHERE token_version > 1")
def revoked_floors(spark, t):
    return fleet.revoked_floors(directory(t))


@query("SELECT q AS queue, CAST(count(*) FILTER (WHERE s = 'F') AS BIGINT) AS done, CAST(count(*) FILTER (WHERE s = 'O') AS BIGINT) AS waiting, CAST(coalesce(greatest(date_diff('second', min(d) FILTER (WHERE s = 'O'), TIMESTAMP '1999-01-01'), 0), 0) AS BIGINT) AS age_s FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('none')) k(q) LEFT JOIN (SELECT o_orderpriority, o_orderstatus AS s, o_orderdate AS d FROM orders) ON o_orderpriority = q GROUP BY 1")
def queue_gauges(spark, t):
    jobs = t("orders").select(F.col("o_orderpriority").alias("queue"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "waiting").otherwise("other").alias("state"), F.col("o_orderdate").alias("at"))
    return reports.queue_gauges(jobs, ["1-URGENT", "2-HIGH", "none"], ["done", "waiting"], "waiting", F.lit("1999-01-01").cast("timestamp_ntz"))


@query("SELECT o_orderpriority AS queue, o_orderstatus AS state, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
def job_counts(spark, t):
    return reports.job_counts(t("orders").select(F.col("o_orderpriority").alias("queue"), F.col("o_orderstatus").alias("state")), ["F", "O"])


@query("SELECT user_id, rate, total FROM (SELECT user_id, round(sum(value), 4) AS rate, row_number() OVER (ORDER BY sum(value) DESC, user_id) AS rn FROM events GROUP BY 1), (SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS total FROM events) WHERE rn <= 10")
def top_with_total(spark, t):
    rates = t("events").groupBy("user_id").agg(F.sum("value").alias("rate"))
    return paging.top_and_total(rates, [F.desc("rate"), "user_id"], 10).select("user_id", F.round("rate", 4).alias("rate"), "total")


@query("SELECT o_custkey, o_orderkey, round(sum(l_extendedprice), 2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') JOIN lineitem ON l_orderkey = o_orderkey WHERE rn = 1 GROUP BY 1, 2")
def delivery_sums(spark, t):
    oldest = t("orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return oldest.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("SELECT CAST(count(*) AS BIGINT) AS stalled FROM orders WHERE o_orderstatus = 'O' AND date_diff('microsecond', o_orderdate, TIMESTAMP '1999-01-01') > 86400000000")
def stalled(spark, t):
    jobs = t("orders").select(F.when(F.col("o_orderstatus") == "O", "available").otherwise("completed").alias("state"), F.col("o_orderdate").alias("scheduled_at"))
    return reports.stalled_jobs(jobs, F.lit("1999-01-01").cast("timestamp_ntz"), 86400)


@query("SELECT n_name AS node_key FROM nation WHERE n_regionkey <> 4 AND n_name <> 'CANADA' AND n_nationkey % 3 <> 0")
def live_set(spark, t):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    seen = F.when(F.col("n_nationkey") % 3 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).otherwise(F.lit("2024-01-01 23:59:30").cast("timestamp_ntz"))
    nodes = t("nation").select(F.col("n_name").alias("node_key"), seen.alias("last_seen_at"), F.when(F.col("n_regionkey") != 4, "h").alias("address"))
    return reports.live_members(nodes, now, 60, "CANADA").select("node_key")


@query("SELECT n_nationkey AS version, CASE WHEN n_regionkey >= 2 THEN true WHEN n_regionkey = 1 THEN n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0 ELSE false END AS accepted FROM nation")
def token_grace(spark, t):
    now, key = F.lit("2024-01-01 00:05:00").cast("timestamp_ntz"), F.col("n_nationkey")
    bumped = F.when(key % 3 != 0, F.lit("2024-01-01 00:03:00").cast("timestamp_ntz"))
    return t("nation").select(key.alias("version"), fleet.token_accepted(F.col("n_regionkey"), F.lit(2), bumped, now, 300, key % 2 == 0).alias("accepted"))


@query("""WITH p AS (SELECT c_custkey AS shard_id, 'n' || c_custkey % 7 AS pinned_node, c_custkey % 5 = 0 AS flying, c_custkey % 3 = 0 AS young, c_custkey % 2 = 0 AS leased FROM customer WHERE c_custkey % 11 <> 0)
SELECT shard_id, pinned_node, CASE WHEN flying THEN 'in_flight' WHEN young THEN 'grace' WHEN NOT leased THEN 'unpin' ELSE 'divergence' END AS action FROM p WHERE pinned_node NOT IN ('n0', 'n1', 'n2')""")
def dead_pins(spark, t):
    c, key = t("customer"), F.col("c_custkey")
    at = F.when(key % 3 == 0, F.lit("2024-01-01 00:04:00")).otherwise(F.lit("2023-01-01")).cast("timestamp_ntz")
    pins = c.select(key.alias("shard_id"), F.concat(F.lit("n"), (key % 7).cast("string")).alias("pinned_node"), at.alias("updated_at"), F.when(key % 11 == 0, at).alias("failed_at"))
    alive = spark.sql("SELECT * FROM VALUES ('n0'), ('n1'), ('n2') AS a(node_key)")
    return policy.dead_pins(pins, alive, c.filter("c_custkey % 5 = 0").select(key.alias("shard_id")), c.filter("c_custkey % 2 = 0").select(key.alias("shard_id"), F.lit("x").alias("owner")), F.lit("2024-01-01 00:05:00").cast("timestamp_ntz"))


@query("SELECT c_custkey AS shard_id FROM customer WHERE c_custkey % 4 = 1 OR c_custkey % 4 = 3")
def cooling_keys(spark, t):
    key = F.col("c_custkey")
    at = F.when(key % 4 == 1, F.lit("2024-01-01 00:04:00")).when(key % 4 == 2, F.lit("2023-01-01")).when(key % 4 == 0, F.lit("2023-06-01")).cast("timestamp_ntz")
    return policy.cooling(t("customer").select(key.alias("shard_id"), at.alias("updated_at")), F.lit("2024-01-01 00:05:00").cast("timestamp_ntz"), 300)


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'object_moved' WHEN n_regionkey >= 2 THEN 'object_advanced' ELSE 'ok' END AS verdict, CASE WHEN n_regionkey = 1 OR n_nationkey % 2 = 0 THEN 'cancel' ELSE 'drop' END AS retire, CASE WHEN n_nationkey = 0 THEN 'unknown' WHEN n_nationkey % 3 = 0 THEN 'aligned' ELSE 'drift' END AS drift, CASE WHEN n_regionkey > 0 AND n_nationkey % 2 = 0 THEN 'both' WHEN n_regionkey > 0 THEN 'data_migration' WHEN n_nationkey % 2 = 0 THEN 'migration_gap' END AS reason FROM nation")
def single_verdicts(spark, t):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return t("nation").select(
        k.alias("k"), reports.still_valid(F.lit(1), F.when(k % 5 == 0, 2).otherwise(1), F.lit(2), r).alias("verdict"), fleet.retire_action(r == 1, k % 2 == 0).alias("retire"),
        fleet.template_drift(F.when(k != 0, k % 3), F.lit(0)).alias("drift"), fleet.review_reason(r, k % 2 == 0).alias("reason"),
    )


@query("SELECT p_partkey AS path, rule, severity FROM part, (VALUES ('atomic_false', 'error', 0), ('run_python', 'warning', 1), ('run_sql', 'warning', 2)) r(rule, severity, m) WHERE p_partkey % 3 = m")
def lint_sources(spark, t):
    m = F.col("p_partkey") % 3
    text = F.concat(F.lit("class M:\n"), F.when(m == 0, "    atomic = False\n").when(m == 1, "    ops = [migrations.RunPython (f)]\n").otherwise("    ops = [RunSQL('x')]\n"))
    return fleet.lint(t("part").select(F.col("p_partkey").alias("path"), text.alias("value")))


@query("SELECT DISTINCT event_id FROM (SELECT event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15')")
def overlap_refresh(spark, t):
    e = t("events").select("event_id", F.col("ts").alias("updated_at"))
    return reports.refreshed(e.filter("event_id % 2 = 0"), e, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 ORDER BY o_orderdate, o_orderkey LIMIT 25")
def least_recent(spark, t):
    rows = t("orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 3 == 0).alias("busy"), (F.col("o_orderstatus") == "F").alias("live"))
    return paging.least_recent(rows, "o_orderdate", "busy", "live", 25, "o_orderkey").select("o_orderkey")


@query("SELECT 'u' || user_id AS label FROM (SELECT DISTINCT user_id FROM events)")
def metric_labels(spark, t):
    lines = t("events").select(F.concat(F.lit('hits_total{user="u'), F.col("user_id").cast("string"), F.lit('"} 1')).alias("value"))
    return prometheus.label_values(prometheus.parse(lines), "hits", "user")


@query("SELECT CAST(sum(n) AS DOUBLE) AS value FROM (SELECT count(*) AS n FROM events WHERE event_type = 'click')")
def metric_value(spark, t):
    counts = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    lines = counts.select(F.concat(F.lit('events_total{kind="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("value"))
    return prometheus.value(prometheus.parse(lines), "events", {"kind": "click"})


CUMULATIVE = "SELECT event_type, le, CAST(count(*) FILTER (WHERE value <= le) AS DOUBLE) AS cum FROM events, (VALUES (10.0::DOUBLE), (50.0), (100.0), (1e308)) b(le) GROUP BY 1, 2"


@query(f"""WITH c AS ({CUMULATIVE}), w AS (SELECT *, max(cum) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER o, 0.0) AS low, coalesce(lag(cum) OVER o, 0.0) AS before FROM c WINDOW o AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(min_by(CASE WHEN le > 1e300 THEN low WHEN cum = before THEN le ELSE low + (0.9 * total - before) / (cum - before) * (le - low) END, le), 6) AS p90 FROM w WHERE cum >= 0.9 * total GROUP BY 1""")
def cumulative_percentile(spark, t):
    le = [10.0, 50.0, 100.0, float("inf")]
    buckets = F.array(*(F.struct(F.lit(x).alias("le"), F.count(F.when(F.col("value") <= x, 1)).cast("double").alias("cum")) for x in le))
    return t("events").groupBy("event_type").agg(buckets.alias("b")).select("event_type", F.round(histograms.percentile_cumulative(F.col("b"), 90), 6).alias("p90"))


@query("SELECT c_nationkey AS k, CAST(greatest(n - coalesce(m, 0), 0) AS DOUBLE) AS grown FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) LEFT JOIN (SELECT s_nationkey, count(*) AS m FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def aligned_difference(spark, t):
    counts = lambda name, key: t(name).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k", F.array(F.struct(F.col("k").cast("double").alias("le"), F.col("n").cast("double").alias("cum"))).alias("b"))
    now, before = counts("customer", "c_nationkey"), counts("supplier", "s_nationkey").withColumnRenamed("b", "old")
    none = F.array().cast("array<struct<le: double, cum: double>>")
    both = now.join(before, "k", "left").select("k", joins.aligned_difference(F.col("b"), F.coalesce("old", none)).alias("d"))
    return both.select("k", F.get("d", F.lit(0))["cum"].alias("grown"))


@query("SELECT event_type, CASE WHEN count(*) >= 300 THEN true ELSE false END AS enough FROM events GROUP BY 1")
def pooled_gate(spark, t):
    pooled = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), histograms.histogram(F.col("value")).alias("h"))
    return pooled.select("event_type", histograms.fleet_p99(F.col("n"), F.col("h"), 300).isNotNull().alias("enough"))


@query("SELECT user_id, event_id, greatest(v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY event_id), 0), 0) AS grown FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS v FROM events)")
def vector_growth(spark, t):
    vectors = t("events").select("user_id", "event_id", F.array(F.floor("value").cast("bigint")).alias("v"))
    return histograms.windowed(vectors, "user_id", "event_id", "v").select("user_id", "event_id", F.get("diff", F.lit(0)).alias("grown"))


in_sql(
    "parsed_forms",
    """SELECT p_partkey, django_date_extract('year', concat(1990 + p_size, '-', 1 + p_size % 12, '-7')) AS y, django_datetime_cast_date(concat(1990 + p_size, '-1-2 3:4:5.5+02:00'), NULL, NULL) AS d, django_time_extract('second', concat('1:2:', p_size)) AS s, django_date_extract('day', 'no date') AS none,
        django_datetime_cast_time(concat('2024-01-15 10:', lpad(p_size, 2, '0'), ':00'), 'UTC+02:30', 'UTC') AS shifted FROM {part} WHERE django_time_extract('minute', '1:02:03') = 2""",
    """SELECT p_partkey, CAST(1990 + p_size AS BIGINT) AS y, CAST(1990 + p_size AS VARCHAR) || '-01-02' AS d, CAST(p_size AS BIGINT) AS s, CAST(NULL AS BIGINT) AS none, strftime(TIMESTAMP '2024-01-15 12:30:00' + to_minutes(CAST(p_size AS INTEGER)), '%H:%M:%S') AS shifted FROM part""",
)


@query("SELECT CAST(1500 AS BIGINT) AS fours, CAST(1500 AS BIGINT) AS sevens, true AS spread")
def distinct_ids(spark, t):
    from quillon.functions import library

    library.register(spark)
    made = spark.range(1500).select(F.expr("uuidv4()").alias("a"), F.expr("uuidv7()").alias("b"), F.rand(7).alias("r"))
    return made.agg(F.count_distinct("a").alias("fours"), F.count_distinct("b").alias("sevens"), ((F.min("r") < 0.05) & (F.max("r") > 0.95) & (F.max("r") < 1)).alias("spread"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value >= 20")
def optional_filters(spark, t):
    return reports.audit_filter(t("events"), {"event_type": "click", "user_id": None}, {"value": 20}).select("event_id")


@query("SELECT user_id, event_id, CASE WHEN b IS NULL THEN NULL WHEN v < b THEN v ELSE v - b END AS grown FROM (SELECT user_id, event_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT user_id, event_id, floor(value) AS v FROM events WHERE event_id % 3 <> 0))")
def baseline_over_failed_ticks(spark, t):
    ticks = t("events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("double")).alias("v"))
    return windows.growth_over_gaps(ticks, "user_id", "event_id", "v").select("user_id", "event_id", "grown")
