"""Registered queries over the standard tables, each with equivalent SQL for another engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import aggregates, library, regex
from quillon.functions.clock import micros
from quillon.operators import dml, histograms, joins, paging, upserts, windows
from quillon.plans import fleet, policy, reports
from quillon.runtime import ship
from quillon.sources import generators, prometheus
from quillon.streaming import processors, sinks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TS = "'yyyy-MM-dd HH:mm:ss.SSSSSS'"
Table = Callable[[str], DataFrame]


def table_of(spark: SparkSession, sf_dir: str) -> Table:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable:
    """Register f(spark, table) under its name."""

    def register(f: Callable[[SparkSession, Table], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), table_of(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def in_sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL that names the standard tables as {table}; the function library is at hand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        library.register(spark)
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


# --- date and time functions -------------------------------------------------------------------

in_sql(
    "trunc_month_zone",
    f"""SELECT django_datetime_trunc('month', date_format(o_orderdate, {TS}), 'America/New_York', 'UTC') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total,
        round(stddev_pop(o_totalprice), 4) AS sd FROM {{orders}} GROUP BY 1""",
    """SELECT strftime(date_trunc('month', timezone('America/New_York', timezone('UTC', o_orderdate))), '%Y-%m-%d %H:%M:%S') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total,
        round(stddev_pop(o_totalprice), 4) AS sd FROM orders GROUP BY 1""",
)
UNITS = ("year", "quarter", "month", "week", "day")
in_sql(
    "trunc_units",
    " UNION ALL ".join(f"SELECT '{u}' AS unit, django_date_trunc('{u}', date_format(o_orderdate, 'yyyy-MM-dd'), NULL, NULL) AS start, count(*) AS n FROM {{orders}} GROUP BY 2" for u in UNITS),
    " UNION ALL ".join(f"SELECT '{u}' AS unit, strftime(date_trunc('{u}', o_orderdate), '%Y-%m-%d') AS start, count(*) AS n FROM orders GROUP BY 2" for u in UNITS),
)
in_sql(
    "trunc_clock_zone",
    " UNION ALL ".join(f"SELECT '{u}' AS unit, django_datetime_trunc('{u}', date_format(ts, {TS}), 'Asia/Kolkata', 'UTC') AS start, count(*) AS n FROM {{events}} GROUP BY 2" for u in ("hour", "minute", "second")),
    " UNION ALL ".join(f"SELECT '{u}' AS unit, strftime(date_trunc('{u}', timezone('Asia/Kolkata', timezone('UTC', ts))), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 2" for u in ("hour", "minute", "second")),
)
PARTS = {"year": "year", "month": "month", "day": "day", "quarter": "quarter", "week": "week", "iso_year": "isoyear", "week_day": None, "iso_week_day": "isodow", "hour": "hour", "minute": "minute", "second": None, "microsecond": None}
DUCK_PARTS = {"week_day": "extract('dow' FROM ts) + 1", "second": "extract('second' FROM ts)", "microsecond": "extract('microsecond' FROM ts) % 1000000"}
in_sql(
    "extract_all",
    "SELECT event_id, " + ", ".join(f"django_datetime_extract('{p}', date_format(ts, {TS}), NULL, NULL) AS p_{p}" for p in PARTS) + " FROM {events}",
    "SELECT event_id, " + ", ".join(f"CAST({DUCK_PARTS.get(p) or f'extract({chr(39)}{d}{chr(39)} FROM ts)'} AS BIGINT) AS p_{p}" for p, d in PARTS.items()) + " FROM events",
)
in_sql(
    "cast_date_time_zone",
    f"SELECT event_id, django_datetime_cast_date(date_format(ts, {TS}), 'Asia/Tokyo', 'UTC') AS d, left(django_datetime_cast_time(date_format(ts, {TS}), 'Asia/Tokyo', 'UTC'), 8) AS t FROM {{events}}",
    "SELECT event_id, strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d') AS d, strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%H:%M:%S') AS t FROM events",
)
in_sql(
    "time_trunc_extract",
    "SELECT event_id, django_time_trunc('minute', date_format(ts, 'HH:mm:ss.SSSSSS'), NULL, NULL) AS m, django_time_extract('hour', date_format(ts, 'HH:mm:ss')) AS h FROM {events}",
    "SELECT event_id, strftime(date_trunc('minute', ts), '%H:%M:%S') AS m, CAST(extract('hour' FROM ts) AS BIGINT) AS h FROM events",
)
in_sql(
    "time_and_stamp_diff",
    f"""SELECT l_orderkey, l_linenumber, django_timestamp_diff(date_format(l_shipdate, {TS}), date_format(o_orderdate, {TS})) AS us, django_time_diff(date_format(l_shipdate, 'HH:mm:ss'), '12:00:00') AS clock_us
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    """SELECT l_orderkey, l_linenumber, date_diff('microsecond', o_orderdate, l_shipdate) AS us, date_diff('microsecond', date_trunc('day', l_shipdate) + INTERVAL 12 HOUR, l_shipdate) AS clock_us
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
DURATIONS = """
WITH d AS (SELECT event_id, CAST(floor(value * 1000000) AS BIGINT) AS us FROM events),
f AS (SELECT event_id, CAST(floor(us / 86400000000.0) AS BIGINT) AS days, us - CAST(floor(us / 86400000000.0) AS BIGINT) * 86400000000 AS r FROM d)
SELECT event_id, CASE WHEN days = 0 THEN '' WHEN abs(days) = 1 THEN days || ' day, ' ELSE days || ' days, ' END || CAST(r // 3600000000 AS VARCHAR) || ':' || lpad(CAST(r // 60000000 % 60 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(r // 1000000 % 60 AS VARCHAR), 2, '0') || CASE WHEN r % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(r % 1000000 AS VARCHAR), 6, '0') END AS text,
  event_id * 3 AS tripled, event_id / 4.0::DOUBLE AS quarter, strftime(DATE '2024-02-28' + CAST(event_id // 24 AS INTEGER), '%Y-%m-%d') AS day FROM f"""
in_sql(
    "duration_arithmetic",
    """SELECT event_id, duration_text(CAST(floor(value * 1000000) AS BIGINT)) AS text, dur_mul_int(event_id, 3) AS tripled, dur_div(event_id, 4) AS quarter, dt_add('2024-02-28', event_id * 3600000000) AS day FROM {events}""",
    DURATIONS,
)
# --- text, hashes, regular expressions, mathematics -----------------------------------------------

in_sql(
    "pad_repeat_reverse",
    "SELECT p_partkey, py_lpad(p_brand, 12, '*-') AS l, py_rpad(p_brand, 12, '*-') AS r, py_lpad(p_brand, -2, 'x') AS cut, py_repeat(p_brand, 2) AS twice, py_repeat(p_brand, -1) AS none, reverse(p_name) AS back, sqlite_upper(p_name) AS up FROM {part}",
    "SELECT p_partkey, lpad(p_brand, 12, '*-') AS l, rpad(p_brand, 12, '*-') AS r, left(p_brand, length(p_brand) - 2) AS cut, repeat(p_brand, 2) AS twice, '' AS none, reverse(p_name) AS back, upper(p_name) AS up FROM part",
)
in_sql("hashes", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s256 FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s256 FROM customer")
in_sql("hashes_long", "SELECT c_custkey, sha224(c_name) AS s224, sha384(c_name) AS s384, sha512(c_name) AS s512 FROM {customer}")
in_sql(
    "math_functions",
    """SELECT o_orderkey, round(sqlite_sqrt(o_totalprice), 6) AS root, sqlite_acos(o_totalprice) AS outside, round(sqlite_ln(o_totalprice), 6) AS ln, round(sqlite_log(2, o_totalprice), 6) AS log2, sqlite_sign(-o_totalprice) AS sgn,
        sqlite_mod(o_orderkey, 7) AS m, sqlite_mod(o_orderkey, 0) AS m0, sqlite_div(o_orderkey, 7) AS q, sqlite_div(o_orderkey, 0) AS q0, bitxor(o_orderkey, 255) AS x, round(sqlite_cot(o_orderkey), 6) AS cot,
        CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(floor(o_totalprice) AS BIGINT) AS down, round(degrees(atan2(o_orderkey, 3)), 6) AS angle FROM {orders}""",
    """SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, CAST(NULL AS DOUBLE) AS outside, round(ln(o_totalprice), 6) AS ln, round(ln(o_totalprice) / ln(2), 6) AS log2, CAST(sign(-o_totalprice) AS INTEGER) AS sgn,
        o_orderkey % 7 AS m, CAST(NULL AS BIGINT) AS m0, o_orderkey // 7 AS q, CAST(NULL AS BIGINT) AS q0, xor(o_orderkey, 255) AS x, round(CASE WHEN o_orderkey <> 0 THEN 1 / tan(o_orderkey) END, 6) AS cot,
        CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(floor(o_totalprice) AS BIGINT) AS down, round(degrees(atan2(o_orderkey, 3)), 6) AS angle FROM orders""",
)


@query("SELECT p_partkey, regexp_matches(p_name, '^[a-z]+ ') AS lower_word, regexp_matches(p_brand, '#[0-9]+\\n?$') AS numbered, regexp_matches(p_type, '(?i)brass|tin') AS metal FROM part")
def regex_search(spark, t):
    return t("part").select("p_partkey", regex.search(F.col("p_name"), r"^[a-z]+ ").alias("lower_word"), regex.search(F.col("p_brand"), r"#\d+$").alias("numbered"), regex.search(F.col("p_type"), r"(?i)brass|tin").alias("metal"))


@query("SELECT p_partkey, regexp_matches(p_name, left(p_name, 2)) AS own FROM part")
def regex_from_column(spark, t):
    return t("part").select("p_partkey", regex.search_column(F.expr("left(p_name, 2)"), F.col("p_name")).alias("own"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# --- projections, filters, joins ----------------------------------------------------------------

in_sql(
    "filter_shapes",
    """SELECT c_custkey, c_name, coalesce(c_mktsegment, 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS band FROM {customer}
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal <> 0 AND c_name ILIKE '%1%' AND c_nationkey IS NOT NULL AND c_nationkey IS DISTINCT FROM 3""",
    """SELECT c_custkey, c_name, coalesce(c_mktsegment, 'none') AS segment, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'plain' END AS band FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal <> 0 AND c_name ILIKE '%1%' AND c_nationkey IS NOT NULL AND c_nationkey IS DISTINCT FROM 3""",
)


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice >= o_totalprice / 2")
def join_over_floor(spark, t):
    lines = t("lineitem").withColumnRenamed("l_orderkey", "key")
    return joins.at_or_over_floor(lines, t("orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 2).alias("floor")), "key", "l_extendedprice", "floor").select(F.col("key").alias("l_orderkey"), "l_linenumber").distinct()


@query("SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def left_join_count(spark, t):
    rich = t("customer").filter("c_acctbal > 9000")
    return t("nation").join(rich, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, t):
    return joins.absent(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, t):
    return joins.members(t("customer").select("c_custkey"), t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS v FROM supplier GROUP BY 1)
SELECT k, kind, lv AS left_value, rv AS right_value FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v IS DISTINCT FROM b.v THEN 'drift' END AS kind, a.v AS lv, b.v AS rv
FROM a FULL JOIN b ON a.k = b.k) WHERE kind IS NOT NULL""")
def mismatch_join(spark, t):
    a = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    b = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return joins.mismatches(a, b, "k", "v", ("only_left", "only_right", "drift"))


@query("SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a CROSS JOIN nation b")
def small_product(spark, t):
    return t("region").select(F.col("r_regionkey").alias("a")).crossJoin(F.broadcast(t("nation").select(F.col("n_nationkey").alias("b"))))


@query("""SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE rn = (n - 1) // 2 + 1""")
def middle_customer(spark, t):
    return windows.middle_row(t("customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_name", "c_custkey"]).select("c_nationkey", "c_custkey")


# --- aggregation --------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first, max(l_shipdate) AS last,
round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_quantity), 5) AS vs FROM lineitem GROUP BY 1, 2""")
def stats_by_group(spark, t):
    d = t("lineitem")
    s = lambda k: aggregates.statistic(d, k, "l_quantity")
    return d.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
        F.round(s("stddev_pop"), 6).alias("sp"), F.round(s("stddev_samp"), 6).alias("ss"), F.round(s("var_pop"), 5).alias("vp"), F.round(s("var_samp"), 5).alias("vs"),
    )


@query("SELECT l_returnflag, bit_and(l_orderkey) AS a, bit_or(CAST(trunc(l_quantity) AS BIGINT)) AS o, bit_xor(l_partkey) AS x FROM lineitem GROUP BY 1")
def bit_aggregates(spark, t):
    d = t("lineitem")
    return d.groupBy("l_returnflag").agg(aggregates.bits(d, "bit_and", "l_orderkey").alias("a"), aggregates.bits(d, "bit_or", "l_quantity").alias("o"), aggregates.bits(d, "bit_xor", "l_partkey").alias("x"))


@query("SELECT o_orderkey, min(c_name) AS name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def any_known_value(spark, t):
    both = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("o_orderkey").agg(aggregates.any_known("c_name").alias("name"))


@query("""SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, coalesce(max(value) FILTER (WHERE value > 50), 0.0) AS top FROM events GROUP BY 1""")
def conditional_counts(spark, t):
    big = F.col("value") > 50
    return t("events").groupBy("event_type").agg(F.count(F.when(big, 1)).alias("high"), F.coalesce(F.max(F.when(big, F.col("value"))), F.lit(0.0)).alias("top"))


@query("""SELECT k.t AS event_type, count(e.event_id) AS n, coalesce(max(date_diff('microsecond', e.ts, m.ts)), 0) AS age_us FROM (VALUES ('click'), ('view'), ('never')) k(t) CROSS JOIN (SELECT max(ts) AS ts FROM events) m LEFT JOIN events e ON e.event_type = k.t GROUP BY 1""")
def zero_filled_gauges(spark, t):
    e = t("events")
    now = e.agg(F.max("ts").alias("now"))
    found = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))
    kinds = spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('never') AS k(event_type)")
    age = F.greatest(F.timestamp_diff("MICROSECOND", F.col("oldest"), F.col("now")), F.lit(0))
    return kinds.join(found, "event_type", "left").join(F.broadcast(now)).select("event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(age, F.lit(0)).alias("age_us"))


EDGES = ", ".join(f"{e}::DOUBLE" for e in histograms.RATE_EDGES)
DUCK_HIST = f"""h AS (SELECT event_type, greatest(len(list_filter([{EDGES}], lambda e: e <= value)) - 1, 0) AS b, count(*) AS c FROM events GROUP BY 1, 2)"""


@query(f"WITH {DUCK_HIST} SELECT event_type, CAST(b AS INTEGER) AS bucket, c AS n FROM h")
def histogram_buckets(spark, t):
    return t("events").groupBy("event_type", histograms.bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DUCK_HIST}, c AS (SELECT event_type, b, c, sum(c) OVER (PARTITION BY event_type ORDER BY b) AS cum, sum(c) OVER (PARTITION BY event_type) AS total FROM h),
x AS (SELECT event_type, min_by(struct_pack(b := b, c := c, cum := cum, total := total), b) AS r FROM c WHERE cum >= 0.99 * total GROUP BY 1)
SELECT event_type, round(CASE WHEN r.b = 15 THEN 50000.0 ELSE [{EDGES}][r.b + 1] + (0.99 * r.total - (r.cum - r.c)) / r.c * ([{EDGES}][r.b + 2] - [{EDGES}][r.b + 1]) END, 6) AS p99 FROM x""")
def histogram_p99(spark, t):
    per_user = t("events").groupBy("event_type", "user_id").agg(histograms.histogram(F.col("value")).alias("h"))
    return per_user.groupBy("event_type").agg(histograms.merged(F.col("h")).alias("h")).select("event_type", F.round(histograms.percentile(F.col("h"), 99), 6).alias("p99"))


@query("SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99, round(median(value), 6) AS mid, max(value) AS top, CAST(round(avg(value)) AS BIGINT) AS mean FROM events GROUP BY 1")
def exact_percentiles(spark, t):
    return t("events").groupBy("event_type").agg(F.round(histograms.exact_percentile("value", 99), 6).alias("p99"), F.round(F.median("value"), 6).alias("mid"), F.max("value").alias("top"), F.round(F.avg("value")).cast("bigint").alias("mean"))


@query("SELECT event_type, list_sort(list(value))[CAST(round((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90 FROM events GROUP BY 1")
def nearest_rank_percentile(spark, t):
    return histograms.nearest_ranks(t("events"), ["event_type"], "value", 90, "p90")


# --- windows, top rows, pages -------------------------------------------------------------------

RUNNING = "SELECT user_id, ts, event_id, sum(floor(value)) OVER (PARTITION BY user_id, event_id // 500 ORDER BY ts, event_id) AS total FROM events"


@query(f"""WITH c AS ({RUNNING}), o AS (SELECT user_id, ts, max(total) AS total FROM c GROUP BY 1, 2), l AS (SELECT user_id, ts, total, lag(total) OVER w AS before, lag(ts) OVER w AS prev_ts FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, ts, round(CASE WHEN total < before THEN total ELSE total - before END / greatest(date_diff('microsecond', prev_ts, ts) / 1000000.0, 0.001), 6) AS rate FROM l""")
def counter_rates(spark, t):
    e = t("events").withColumns({"chunk": F.expr("event_id div 500"), "whole": F.floor("value").cast("double")})
    counters = e.withColumn("total", windows.running_sum("whole", ["ts", "event_id"], ["user_id", "chunk"])).groupBy("user_id", "ts").agg(F.max("total").alias("total"))
    return windows.counter_rate(counters, "user_id", "ts", "total").select("user_id", "ts", F.round("rate", 6).alias("rate"))


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, t):
    return windows.latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", ["event_id"])


SAMPLES = "SELECT user_id AS shard_id, event_type AS node_key, ts AS sampled_at, value AS q_per_s, event_id FROM events"


def samples(t: Table) -> DataFrame:
    return t("events").select(F.col("user_id").alias("shard_id"), F.col("event_type").alias("node_key"), F.col("ts").alias("sampled_at"), F.col("value").alias("q_per_s"))


LAST = "last AS (SELECT shard_id, node_key, q_per_s FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY sampled_at DESC, node_key DESC) AS rn FROM s) WHERE rn = 1)"


@query(f"WITH s AS ({SAMPLES}), {LAST} SELECT s.shard_id, count(DISTINCT sampled_at) AS windows FROM s JOIN last USING (shard_id, node_key) WHERE s.q_per_s >= 60 GROUP BY 1 HAVING count(DISTINCT sampled_at) >= 2")
def confirmed_hot(spark, t):
    return windows.confirmed(samples(t), "shard_id", "node_key", "sampled_at", "q_per_s", 60, 2, ["node_key"])


@query(f"WITH s AS ({SAMPLES}), {LAST} SELECT node_key, round(sum(q_per_s), 4) AS load FROM last GROUP BY 1")
def node_load(spark, t):
    return policy.node_load(samples(t), "shard_id", "node_key", "sampled_at", "q_per_s").select("node_key", F.round("load", 4).alias("load"))


@query(f"WITH s AS ({SAMPLES}), {LAST} SELECT shard_id, node_key, q_per_s FROM last ORDER BY q_per_s DESC, shard_id LIMIT 50")
def hot_shards(spark, t):
    return paging.top(windows.latest(samples(t), ["shard_id"], "sampled_at", ["node_key"]), [F.desc("q_per_s"), "shard_id"], 50).select("shard_id", "node_key", "q_per_s")


@query(f"WITH s AS ({SAMPLES}), {LAST} SELECT round(20 * quantile_cont(q_per_s, 0.99), 6) AS threshold FROM last")
def hot_threshold(spark, t):
    last = windows.latest(samples(t), ["shard_id"], "sampled_at", ["node_key"])
    return last.agg(F.round(policy.hot_threshold(last, "q_per_s"), 6).alias("threshold"))


@query()
def move_plan(spark, t):
    s = samples(t)
    nodes = [r["node_key"] for r in s.select("node_key").distinct().orderBy("node_key").collect()]  # the fleet's nodes
    none = spark.createDataFrame([], "shard_id bigint, updated_at timestamp_ntz")
    moves = policy.propose(s, none, nodes, F.lit("2100-01-01").cast("timestamp"), floor=50.0, max_moves=20)
    return spark.createDataFrame([tuple(m.values()) for m in moves], "shard_id bigint, from_node string, to_node string, q_per_s double, threshold double")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 51 OFFSET 100")
def page_of_orders(spark, t):
    return paging.page(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], None, 100)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40")
def keyset_page(spark, t):
    return paging.after(t("orders").select("o_orderkey"), "o_orderkey", 500, 40)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def newest_three(spark, t):
    return windows.newest(t("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("""WITH a AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, round(len(list_intersect(a.l, b.l)) * 1.0::DOUBLE / len(list_distinct(list_concat(a.l, b.l))), 6) AS j FROM a JOIN b USING (user_id)""")
def jaccard_of_windows(spark, t):
    e = t("events")
    a, b = (e.filter(F.col("event_id") % 2 == i).groupBy("user_id").agg(F.collect_set("event_type").alias(n)) for i, n in ((0, "a"), (1, "b")))
    return a.join(b, "user_id").select("user_id", F.round(joins.jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query("SELECT CAST(x AS BIGINT) AS x FROM range(1, 1001) r(x)")
def row_generator(spark, t):
    return generators.sequence(spark, 1, 1000)


# --- directory, retention, reconciliation -----------------------------------------------------------

DIRECTORY = """SELECT c_custkey AS shard_id, CASE WHEN c_custkey % 11 = 0 THEN 'deleted' WHEN c_custkey % 13 = 0 THEN 'migrating' ELSE 'active' END AS status, CAST(c_custkey % 5 AS BIGINT) AS schema_version, CAST(c_custkey % 3 AS BIGINT) AS token_version,
a.last_active_at, f.last_flushed_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_active_at FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_flushed_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = c_custkey"""


def directory(t: Table) -> DataFrame:
    orders = t("orders")
    active = orders.groupBy(F.col("o_custkey").alias("shard_id")).agg(F.max("o_orderdate").alias("last_active_at"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_flushed_at"))
    key = F.col("shard_id")
    status = F.when(key % 11 == 0, "deleted").when(key % 13 == 0, "migrating").otherwise("active")
    shards = t("customer").select(F.col("c_custkey").alias("shard_id"))
    return shards.join(active, "shard_id", "left").select("shard_id", status.alias("status"), (key % 5).alias("schema_version"), (key % 3).alias("token_version"), "last_active_at", "last_flushed_at")


@query(f"WITH d AS ({DIRECTORY}) SELECT shard_id, last_active_at, last_flushed_at FROM d WHERE status <> 'deleted' AND last_active_at IS NOT NULL AND (last_flushed_at IS NULL OR last_active_at > last_flushed_at) ORDER BY last_active_at DESC, shard_id LIMIT 100")
def loss_report(spark, t):
    return fleet.loss_report(directory(t), 100).select("shard_id", "last_active_at", "last_flushed_at")


@query(f"WITH d AS ({DIRECTORY}) SELECT shard_id FROM d WHERE status = 'active' AND schema_version < 3 AND shard_id <> 1")
def laggards(spark, t):
    return fleet.laggards(directory(t), F.lit(3), "1").select("shard_id")


@query(f"WITH d AS ({DIRECTORY}) SELECT shard_id FROM d WHERE status = 'active' ORDER BY last_flushed_at ASC NULLS FIRST, shard_id LIMIT 30")
def drill_sample(spark, t):
    return fleet.drill_sample(directory(t), "last_flushed_at", 30).select("shard_id")


@query(f"WITH d AS ({DIRECTORY}) SELECT status, count(*) AS n FROM d GROUP BY 1")
def status_counts(spark, t):
    return directory(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS ({DIRECTORY}), c AS (SELECT count(*) FILTER (WHERE status = 'active' AND schema_version < 3) AS lag, count(*) FILTER (WHERE schema_version >= 3) AS done FROM d)
SELECT lag AS remaining, done AS cut_over, CAST(CASE WHEN lag = 0 THEN 0 WHEN done > 0 THEN ceil(lag / (done / 3600.0)) END AS BIGINT) AS eta_s FROM c""")
def rollout_eta(spark, t):
    d = directory(t).agg(F.count(F.when((F.col("status") == "active") & (F.col("schema_version") < 3), 1)).alias("remaining"), F.count(F.when(F.col("schema_version") >= 3, 1)).alias("cut_over"))
    return d.withColumn("eta_s", fleet.rollout_eta(F.col("remaining"), F.col("cut_over"), 3600.0))


@query("""WITH v AS (SELECT p_partkey AS version, p_size % 7 = 0 AS yanked, p_partkey % 40 = 39 AS requires_review FROM part), b AS (SELECT min(version) AS x FROM v WHERE requires_review)
SELECT CAST(coalesce(max(version), 0) AS BIGINT) AS head FROM v, b WHERE NOT yanked AND (x IS NULL OR version < x)""")
def head_version(spark, t):
    return fleet.head_version(t("part").select(F.col("p_partkey").alias("version"), (F.col("p_size") % 7 == 0).alias("yanked"), (F.col("p_partkey") % 40 == 39).alias("requires_review")))


@query(f"""WITH d AS ({DIRECTORY}), i AS (SELECT o_custkey AS shard_id, o_orderkey AS issuance, CAST(o_orderkey % 4 AS BIGINT) AS issued_version FROM orders) SELECT i.shard_id, issuance FROM i LEFT JOIN d USING (shard_id) WHERE issued_version >= coalesce(token_version, 1)""")
def outstanding_tokens(spark, t):
    issued = t("orders").select(F.col("o_custkey").alias("shard_id"), F.col("o_orderkey").alias("issuance"), (F.col("o_orderkey") % 4).alias("issued_version"))
    return fleet.outstanding_tokens(issued, directory(t)).select("shard_id", "issuance")


@query(f"""WITH d AS ({DIRECTORY}), st AS (SELECT s_suppkey AS shard_id, CAST(s_suppkey % 4 AS BIGINT) AS user_version, CAST(s_suppkey % 6 AS BIGINT) AS token_floor FROM supplier), l AS (SELECT d.*, user_version, token_floor FROM d LEFT JOIN st USING (shard_id) WHERE status <> 'deleted')
SELECT shard_id, 'missing_object' AS kind, CAST(NULL AS BIGINT) AS from_value, CAST(NULL AS BIGINT) AS to_value FROM l WHERE user_version IS NULL
UNION ALL SELECT shard_id, 'schema_drift', schema_version, user_version FROM l WHERE user_version <> schema_version UNION ALL SELECT shard_id, 'token_drift', token_version, token_floor FROM l WHERE token_floor > token_version
UNION ALL SELECT s_suppkey, 'orphan_tombstone', NULL, NULL FROM supplier WHERE s_suppkey % 10 = 1 AND s_suppkey NOT IN (SELECT shard_id FROM d WHERE status = 'deleted')""")
def reconcile_directory(spark, t):
    s = t("supplier")
    stored = s.select(F.col("s_suppkey").alias("shard_id"), (F.col("s_suppkey") % 4).alias("user_version"), (F.col("s_suppkey") % 6).alias("token_floor"))
    return fleet.reconcile(directory(t), stored, s.filter("s_suppkey % 10 = 1").select(F.col("s_suppkey").alias("shard_id")))


SNAPS = "SELECT DISTINCT user_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || event_id || CASE WHEN event_id % 5 = 0 THEN '' ELSE '-auto' END AS id, date_trunc('second', ts) AS ts, event_id % 5 <> 0 AS auto FROM events"


def _kept(period: str, n: int) -> str:
    return f"SELECT user_id, id FROM (SELECT user_id, p, max(ROW(ts, id)) AS r, max_by(id, (ts, id)) AS id, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC) AS rn FROM (SELECT *, {period} AS p FROM a) GROUP BY user_id, p) WHERE rn <= {n}"


@query(f"""WITH s AS ({SNAPS}), a AS (SELECT * FROM s WHERE auto), k AS ({_kept("strftime(ts, '%Y%m%d%H')", 5)} UNION {_kept("strftime(ts, '%Y%m%d')", 3)} UNION {_kept("CAST(isoyear(ts) * 100 + week(ts) AS VARCHAR)", 2)})
SELECT s.user_id, s.id, CASE WHEN NOT auto THEN 'ineligible' WHEN k.id IS NOT NULL THEN 'keep' ELSE 'drop' END AS plan FROM s LEFT JOIN k ON s.user_id = k.user_id AND s.id = k.id""")
def snapshot_retention(spark, t):
    label = F.when(F.col("event_id") % 5 == 0, "").otherwise("-auto")
    ids = t("events").select("user_id", F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.col("event_id").cast("string"), label).alias("id")).distinct()
    return fleet.retention(ids, F.lit("2100-01-01"), 5, 3, 2, "user_id").select("user_id", "id", "plan")


@query("""WITH a AS (SELECT event_type AS metric, avg(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1),
j AS (SELECT metric, a.value AS x, b.value AS y, round((b.value - a.value) / a.value * 100, 2) AS pct FROM a JOIN b USING (metric)) SELECT metric, pct, CASE WHEN pct >= 20 THEN 'block' WHEN pct > 1 THEN 'warn' ELSE 'ok' END AS verdict FROM j""")
def regression_gate(spark, t):
    half = lambda i: t("events").filter(F.col("event_id") % 2 == i).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    metrics = t("events").select(F.col("event_type").alias("metric")).distinct().withColumns({"direction": F.lit("higher_worse"), "block": F.lit(20.0)})
    return fleet.gate(half(0), half(1), metrics, 1.0).select("metric", "pct", "verdict")


@query(f"""WITH d AS ({DIRECTORY}), b AS (SELECT o_custkey AS shard_id, max(o_orderdate + INTERVAL 5 DAY) AS ts FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT shard_id, greatest(last_active_at, b.ts) AS last_active_at, status FROM d LEFT JOIN b USING (shard_id)""")
def upsert_newest(spark, t):
    batch = t("orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("shard_id"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAY")).alias("last_active_at"))
    return upserts.newest_wins(directory(t), batch, "shard_id", "last_active_at", {"status": F.lit("active")}).select("shard_id", "last_active_at", "status")


@query(f"WITH d AS ({DIRECTORY}) SELECT shard_id, CASE WHEN status = 'migrating' THEN 'active' ELSE status END AS status FROM d")
def reclaim_stale(spark, t):
    return upserts.conditional(directory(t), F.col("status") == "migrating", {"status": F.lit("active")})[0].select("shard_id", "status")


# --- transaction workloads -----------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, count(*) FILTER (WHERE event_type <> 'click') AS foreign_rows FROM events GROUP BY 1")
def tenant_sums(spark, t):
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count(F.when(F.col("event_type") != "click", 1)).alias("foreign_rows"))


@query("SELECT o_custkey, o_orderkey, count(l_linenumber) AS lines, round(sum(l_extendedprice), 2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE rn = 1 GROUP BY 1, 2")
def order_status(spark, t):
    last = windows.latest(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return last.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_custkey", "o_orderkey").agg(F.count("l_linenumber").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS low FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 15 GROUP BY 1")
def stock_level(spark, t):
    return t("lineitem").join(t("part").filter("p_size < 15"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("low"))


# --- processors and sources ----------------------------------------------------------------------


def _arrivals(t: Table) -> DataFrame:
    return t("events").select("user_id", "event_id", micros(F.col("ts")).alias("at"))


@query()
def fixed_window_limiter(spark, t):
    return processors.over_table(_arrivals(t), "user_id", ["at", "event_id"], processors.FixedWindow(2, 3_600_000_000))


@query()
def token_bucket_limiter(spark, t):
    return processors.over_table(_arrivals(t), "user_id", ["at", "event_id"], processors.TokenBucket(1 / 3_600_000_000, 2.0))


@query()
def log_apply(spark, t):
    e = t("events").select("user_id", "event_id", (F.col("event_id") % 3).alias("epoch"), F.lit(0).cast("long").alias("gen"), F.lit(7).cast("long").alias("salt"), (F.col("event_id") % 2 * 10).alias("pos"), F.lit(10).cast("long").alias("size"))
    return processors.over_table(e, "user_id", ["event_id"], processors.LogApply())


@query("""WITH e AS (SELECT user_id AS shard, event_type AS node, event_id % 4 AS epoch, event_id % 5 AS gen, event_id AS pos, event_id % 7 = 0 AS torn FROM events) SELECT shard, node, epoch, gen, pos FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY epoch DESC, gen DESC, pos DESC, node DESC) AS rn FROM e WHERE NOT torn) WHERE rn = 1""")
def freshest_replica(spark, t):
    e = t("events").select(F.col("user_id").alias("shard"), F.col("event_type").alias("node"), (F.col("event_id") % 4).alias("epoch"), (F.col("event_id") % 5).alias("gen"), F.col("event_id").alias("pos"), (F.col("event_id") % 7 == 0).alias("torn"))
    return sinks.fresher_replica(e, "shard")


@query("SELECT 'm_' || event_type AS name, 'u' || user_id AS user_label, value FROM events")
def metrics_text(spark, t):
    lines = t("events").select(F.concat(F.lit("m_"), "event_type", F.lit('{user="u'), F.col("user_id").cast("string"), F.lit('",le="+Inf"} '), F.col("value").cast("decimal(20,10)").cast("string")).alias("value"))
    parsed = prometheus.parse(lines.union(spark.sql("SELECT 'broken line {' AS value UNION ALL SELECT 'm NaN'")))
    return parsed.select("name", F.col("labels").getItem("user").alias("user_label"), "value")


@query()
def random_values(spark, t):
    library.register(spark)
    return t("region").select("r_regionkey", F.expr("length(uuidv4())").alias("v4"), F.expr("length(uuidv7())").alias("v7"), (F.rand() < 1).alias("r"))


# --- further reports -------------------------------------------------------------------------------


@query(f"""WITH d AS ({DIRECTORY}) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'migrating') AS migrating, count(*) FILTER (WHERE status = 'deleted') AS deleted,
count(*) FILTER (WHERE status = 'active' AND schema_version = 4) AS at_head, count(*) FILTER (WHERE status = 'active' AND schema_version < 4) AS behind FROM d""")
def fleet_overview(spark, t):
    return reports.overview(directory(t), F.lit(4))


@query("SELECT n_name AS node_key, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS alive FROM nation")
def node_roster(spark, t):
    alive = t("supplier").filter("s_acctbal > 5000").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("node_key"))
    return reports.roster(t("nation").select(F.col("n_name").alias("node_key")), alive)


@query("""WITH a AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rows FROM events), k AS (SELECT user_id, ts, max(rows) AS rows FROM a GROUP BY 1, 2), f AS (SELECT user_id, ts, max(rows) AS rows FROM a WHERE event_id % 5 = 0 GROUP BY 1, 2)
SELECT k.user_id, k.ts AS at, k.rows - coalesce(max(f.rows), 0) AS lost_rows, round(greatest(date_diff('microsecond', max(f.ts), k.ts) / 1000.0::DOUBLE, 0.0), 3) AS lost_ms FROM k LEFT JOIN f ON f.user_id = k.user_id AND f.ts <= k.ts GROUP BY k.user_id, k.ts, k.rows""")
def loss_window_samples(spark, t):
    e = t("events").withColumn("rows", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint"))
    acked = e.groupBy("user_id", F.col("ts").alias("at")).agg(F.max("rows").alias("rows"))
    flushed = e.filter("event_id % 5 = 0").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("rows").alias("rows"))
    found = reports.loss_samples(acked, flushed, "user_id").withColumn("lost_ms", F.round("lost_ms", 3))
    return found.select("user_id", "at", "lost_rows", F.when(F.col("lost_ms").isNull(), 0.0).otherwise(F.col("lost_ms")).alias("lost_ms"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, CAST(round(avg(value)) AS BIGINT) AS mean FROM events")
def distribution_summary(spark, t):
    d = reports.distribution(t("events"), "value")
    return d.select(*(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")), "max", "mean")


@query("""WITH r AS (SELECT user_id, sum(value) AS rate FROM events GROUP BY 1), m AS (SELECT user_id FROM r ORDER BY rate DESC, user_id LIMIT 20), x AS (SELECT unnest([0.0, 100.0, 500.0, 1000.0, 5000.0]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE rate >= threshold) AS flagged, round(count(*) FILTER (WHERE rate >= threshold AND user_id IN (SELECT user_id FROM m)) / CAST((SELECT count(*) FROM m) AS DOUBLE), 6) AS recall FROM r, x GROUP BY 1""")
def hotspot_sweep(spark, t):
    rates = t("events").groupBy("user_id").agg(F.sum("value").alias("rate"))
    return reports.threshold_sweep(rates, "user_id", "rate", [0.0, 100.0, 500.0, 1000.0, 5000.0], 20).withColumn("recall", F.round("recall", 6))


@query("""WITH c AS (SELECT user_id, ts, event_id, sum(floor(value)) OVER (PARTITION BY user_id, event_id // 500 ORDER BY ts, event_id) AS total FROM events), o AS (SELECT user_id, ts, max(total) AS total FROM c GROUP BY 1, 2), l AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM o)
SELECT user_id, date_trunc('day', ts) AS start, sum(CASE WHEN b IS NULL THEN 0.0 WHEN total < b THEN total ELSE total - b END) AS increase, round(sum(CASE WHEN b IS NULL THEN 0.0 WHEN total < b THEN total ELSE total - b END) / 86400.0, 9) AS rate FROM l GROUP BY 1, 2""")
def counter_increase(spark, t):
    e = t("events").withColumns({"chunk": F.expr("event_id div 500"), "whole": F.floor("value").cast("double")})
    counters = e.withColumn("total", windows.running_sum("whole", ["ts", "event_id"], ["user_id", "chunk"])).groupBy("user_id", "ts").agg(F.max("total").alias("total"))
    return reports.increase(counters, ["user_id"], "ts", "total", "1 day").withColumn("rate", F.round("rate", 9))


@query("SELECT count(*) AS remaining, count(*) FILTER (WHERE shard_id % 4 = 0) AS in_flight, count(*) FILTER (WHERE shard_id % 4 = 2) AS failed FROM (" + DIRECTORY + ") WHERE schema_version = 2 AND status <> 'deleted'")
def revert_progress(spark, t):
    key = F.col("c_custkey")
    jobs = t("customer").filter(key % 2 == 0).select(key.alias("shard_id"), F.when(key % 4 == 0, "executing").otherwise("discarded").alias("state"))
    return reports.revert_status(directory(t), jobs, 2)


@query(f"WITH d AS ({DIRECTORY}) SELECT shard_id FROM d WHERE status <> 'deleted' AND schema_version = 4")
def stranded_shards(spark, t):
    versions = spark.range(6).select(F.col("id").alias("version"), (F.col("id") == 4).alias("yanked"))
    return reports.stranded(directory(t), versions, F.lit(3)).select("shard_id")


@query(f"WITH d AS ({DIRECTORY}), w AS (SELECT shard_id FROM d WHERE status = 'active' AND last_active_at IS NOT NULL ORDER BY last_active_at DESC, shard_id LIMIT 40) SELECT shard_id, last_flushed_at AS checked_at FROM w JOIN d USING (shard_id)")
def warm_set(spark, t):
    d = directory(t)
    return reports.warm_set(d, d.select("shard_id", F.col("last_flushed_at").alias("checked_at")), 40).select("shard_id", "checked_at")


@query("WITH w AS (SELECT user_id, max(event_id) AS c FROM events GROUP BY 1), f AS (SELECT user_id, max(event_id) AS c FROM events WHERE event_type = 'click' GROUP BY 1) SELECT w.user_id FROM w LEFT JOIN f USING (user_id) WHERE f.c IS NULL OR w.c > f.c")
def dirty_keys(spark, t):
    writes = t("events").select("user_id", F.col("event_id").alias("at"), F.lit(1).alias("gen"), F.col("event_id").alias("count"), "event_type")
    return reports.dirty(writes.drop("event_type"), writes.filter("event_type = 'click'").drop("event_type"), "user_id")


@query("SELECT true AS sums_agree, true AS isolated, true AS complete FROM (SELECT 1)")
def tpcb_consistency(spark, t):
    e = t("events").select("user_id", "event_id", F.floor("value").alias("delta"))
    sums = lambda k, name: e.groupBy((F.col("event_id") % k).alias("id")).agg(F.sum("delta").alias(name))
    return reports.tpcb_consistent(sums(1, "bbalance"), sums(10, "tbalance"), sums(100, "abalance"), e.withColumn("filler", F.lit("w")), "w", e.count())


@query()
def transactions(spark, t):
    kinds = F.when(F.col("event_type") == "click", "begin").when(F.col("event_type") == "purchase", "commit").otherwise("other")
    return processors.over_table(t("events").select("user_id", "event_id", kinds.alias("kind")), "user_id", ["event_id"], processors.Transactions())


@query()
def quorum_counts(spark, t):
    acks = t("events").select(F.col("user_id").alias("write"), "event_id", F.col("event_type").alias("node"), (F.col("event_id") % 4 != 0).alias("ok"))
    return processors.over_table(acks, "write", ["event_id"], processors.Quorum(4, 2))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'reset' WHEN c_custkey % 50 = 0 THEN 'nothing' ELSE 'append' END AS action, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 50 * 2 END AS start, least(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 * 2 + c_custkey % 50 ELSE c_custkey % 50 END, 30) AS bytes FROM customer")
def log_shipping(spark, t):
    key = F.col("c_custkey")
    primary = t("customer").select(key.alias("k"), F.when(key % 3 == 0, 2).otherwise(1).alias("gen"), F.lit(7).alias("salt"), (key % 50 * 3).alias("extent"))
    follower = t("customer").select(key.alias("k"), F.lit(1).alias("gen"), F.lit(7).alias("salt"), (key % 50 * 2).alias("pos"))
    return sinks.shipping(primary, follower, "k", 30)


in_sql(
    "formats_and_quotes",
    "SELECT event_id, sqlite_strftime('%Y-%m %H:%M', ts) AS f, sqlite_quote(event_type) AS q, sqlite_lower(upper(event_type)) AS low, typeof(value) AS kind FROM {events}",
    "SELECT event_id, strftime(ts, '%Y-%m %H:%M') AS f, chr(39) || event_type || chr(39) AS q, lower(event_type) AS low, 'double' AS kind FROM events",
)


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS p_size FROM part WHERE p_size <> 3")
def row_changes(spark, t):
    part = t("part").select("p_partkey", "p_name", "p_size")
    return dml.delete(dml.update(part, F.col("p_size") > 40, {"p_size": F.lit(40)})[0], F.col("p_size") == 3)[0]


@query("""WITH s AS (SELECT c_custkey AS shard_id, c_custkey % 3 AS epoch, c_custkey % 4 AS gen, c_custkey % 50 AS pos FROM customer), o AS (SELECT shard_id, node, epoch, gen, pos FROM (SELECT o_custkey AS shard_id, o_orderpriority AS node, o_orderkey % 3 AS epoch, o_orderkey % 4 AS gen, o_orderkey % 50 AS pos FROM orders)),
f AS (SELECT o.*, row_number() OVER (PARTITION BY o.shard_id ORDER BY o.epoch DESC, o.gen DESC, o.pos DESC, o.node = '1-URGENT' DESC, o.node DESC) AS rn FROM o JOIN s USING (shard_id) WHERE (o.epoch, o.gen, o.pos) > (s.epoch, s.gen, s.pos))
SELECT s.shard_id, coalesce(f.node, 'object') AS source FROM s LEFT JOIN f ON f.shard_id = s.shard_id AND f.rn = 1""")
def best_copies(spark, t):
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    stored = t("customer").select(key.alias("shard_id"), (key % 3).alias("epoch"), (key % 4).alias("gen"), (key % 50).alias("pos"))
    offers = t("orders").select(F.col("o_custkey").alias("shard_id"), F.col("o_orderpriority").alias("node"), (order % 3).alias("epoch"), (order % 4).alias("gen"), (order % 50).alias("pos"))
    return reports.best_copy(stored, offers, "1-URGENT")


@query("""WITH x AS (SELECT o_orderstatus AS kind, o_orderdate AS began, CAST(floor(o_totalprice) AS BIGINT) AS us FROM orders), m AS (SELECT (max(epoch_us(began) + us) - min(epoch_us(began))) / 60000000.0::DOUBLE AS minutes FROM x)
SELECT kind, count(*) AS n, round(quantile_cont(us, 0.5), 4) AS p50, round(quantile_cont(us, 0.99), 4) AS p99, max(us) AS max, round(count(*) / max(minutes), 9) AS per_minute FROM x, m GROUP BY 1""")
def transaction_latencies(spark, t):
    txns = t("orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("began"), F.floor("o_totalprice").cast("bigint").alias("us"))
    return reports.transaction_summary(txns).withColumns({"p50": F.round("p50", 4), "p99": F.round("p99", 4), "per_minute": F.round("per_minute", 9)})


@query(f"""WITH d AS ({DIRECTORY}), m AS (SELECT max(o_orderdate) AS now FROM orders) SELECT count(*) FILTER (WHERE dirty) AS dirty, round(max(CASE WHEN dirty THEN date_diff('microsecond', last_active_at, now) / 1000000.0::DOUBLE END), 3) AS oldest_s
FROM (SELECT *, last_active_at IS NOT NULL AND (last_flushed_at IS NULL OR last_active_at > last_flushed_at) AS dirty FROM d), m""")
def dirty_ages(spark, t):
    now = t("orders").agg(F.max("o_orderdate")).first()[0]
    return reports.dirty_age(directory(t), F.lit(str(now))).withColumn("oldest_s", F.round("oldest_s", 3))


@query("SELECT shard_id, to_node, shard_id % 2 = 0 AS hit FROM (SELECT c_custkey AS shard_id, 'n' || c_custkey % 5 AS to_node FROM customer)")
def warm_moves(spark, t):
    moves = t("customer").select(F.col("c_custkey").alias("shard_id"), F.concat(F.lit("n"), (F.col("c_custkey") % 5).cast("string")).alias("to_node"))
    return reports.affinity(moves, moves.filter("shard_id % 2 = 0").withColumnRenamed("to_node", "node_key"))


from quillon import more_queries  # noqa: E402, F401  (it registers its queries here)
