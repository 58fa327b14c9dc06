"""Tenant SQL in the tenant's own words, and writes."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import library
from quillon.tenant import dialect, errors
from quillon.tenant.session import TenantSession

ORDERS = "id long, created string, due string, at string, span long, note string, qty long, price double"


@pytest.fixture(scope="module")
def tenant(spark):
    rows = [
        (1, "2026-08-05 13:45:59.123456", "2026-08-05", "13:45:59", 3_600_000_000, "alpha", 3, 9.99), (2, "2026-08-05 03:30:00", "2026-08-31", "03:30:00", 1, "beta\n", 0, 0.1), (3, "2027-01-01 02:00:00", "2027-01-01", "02:00:00", 86_400_000_000, "Gamma", 7, 5.25),
        (4, "2024-02-29 12:00:00", "2024-02-29", "12:00:00", -1, "delta Éa", 2, 1.5), (5, None, None, None, None, None, None, None), (6, "2026-12-31 23:59:59.999999", "2026-12-31", "23:59:59.999999", 0, "zed-1", 4, 0.9),
    ]
    return TenantSession(spark, "shop", {"app_order": spark.createDataFrame(rows, ORDERS)})


def test_functions_answer_under_their_own_names(tenant):
    one = lambda e: tenant.rows(f"SELECT {e} AS x")[0]["x"]
    assert one("LPAD('abc', -1, 'x')") == "ab" and one("LPAD('x', 3, '0')") == "00x" and one("RPAD('x', 3, '0')") == "x00" and one("REPEAT('x', -2)") == "" and one("REVERSE('abc')") == "cba"
    assert one("1 / 0") is None and one("5 % 0") is None and one("MOD(5, 0)") is None and one("MOD(5, 2)") == 1 and one("BITXOR(1, 2)") == 3
    assert one("ACOS(2)") is None and one("LOG(2, 8)") == pytest.approx(3) and one("LOG(100)") == pytest.approx(2) and one("LN(0)") is None and one("POWER(2, 3)") == 8 and one("SIGN(-2)") == -1
    assert math.isclose(one("COT(1)"), 1 / math.tan(1)) and one("SQRT(-1)") is None and one("PI()") == pytest.approx(math.pi) and one("CEILING(1.2)") == 2 and one("FLOOR(1.2)") == 1
    assert one("LOWER('ÀBC')") == "Àbc" and one("strftime('%Y', '2026-08-05')") == "2026" and one("json_extract('{\"a\":1}', '$.a')") == "1" and one("QUOTE('it''s')") == "'it''s'" and one("QUOTE(3)") == "3"
    assert len(one("UUIDV4()")) == 32 and len(one("randomblob(20)")) == 20 and one("typeof(1)") == "integer" and one("typeof(1.5)") == "real" and one("typeof('x')") == "text" and one("typeof(NULL)") == "null"


def test_every_version_seven_id_is_its_own(spark):
    library.register(spark)
    ids = [r["u"] for r in spark.range(1000).select(F.expr("uuidv7()").alias("u")).collect()]
    assert len(set(ids)) == 1000 and all(len(u) == 32 and u[12] == "7" and u[16] in "89ab" for u in ids)


def test_durations_by_connector(tenant):
    q = lambda e, where="id = 1": tenant.rows(f"SELECT {e} AS x FROM app_order WHERE {where}")[0]["x"]
    assert q("django_format_dtdelta('+', span, span)") == "2:00:00" and q("django_format_dtdelta('-', span, 1)") == "0:59:59.999999" and q("django_format_dtdelta('*', qty, 2)") == 6 and q("django_format_dtdelta('/', qty, 2)") == 1.5
    assert q("django_format_dtdelta('+', created, 1)") == "2026-08-05 13:45:59.123457" and q("django_format_dtdelta('-', created, created)") == "0:00:00" and q("django_format_dtdelta('+', span, span)", "id = 5") is None
    assert q("typeof(django_format_dtdelta('+', span, span))") == "text" and q("typeof(django_format_dtdelta('*', qty, 2))") == "integer"
    with pytest.raises(errors.TenantError):
        q("django_format_dtdelta('^', span, 1)")


def test_patterns_mean_what_they_mean_to_clients(tenant):
    ids = lambda where: [r["id"] for r in tenant.rows(f"SELECT id FROM app_order WHERE {where} ORDER BY id")]
    assert ids("note REGEXP '^[a-z]'") == [1, 2, 4, 6] and ids("note REGEXP 'a$'") == [1, 2, 3, 4] and ids("note REGEXP '(?i)GAMMA'") == [3] and ids(r"note REGEXP '(.)\1'") == [3]
    assert ids("note REGEXP '(?i)é'") == [4] and ids("note REGEXP '(?P<x>l)'") == [1, 4] and ids("regexp('^z', note)") == [6] and ids("note NOT REGEXP 'a'") == [6]
    assert ids("note LIKE 'ALPH_'") == [1] and ids("\"note\" LIKE 'z%' OR [id] = 3") == [3, 6] and ids("note = 'beta\n'") == [2]
    with pytest.raises(errors.TenantError, match="pattern"):
        ids("note REGEXP '('")


def test_statistics_refuse_text(tenant):
    assert tenant.rows("SELECT BIT_OR(qty) AS b, round(STDDEV_POP(price), 6) AS s, COUNT(*) AS n FROM app_order")[0]["b"] == 7
    with pytest.raises(errors.TenantError):
        tenant.rows("SELECT STDDEV_POP(note) FROM app_order")


def test_rewriting_leaves_quotes_and_comments():
    assert dialect.translate("SELECT 'LIKE lpad(' /* lpad( */ FROM t -- like") == "SELECT 'LIKE lpad(' /* lpad( */ FROM t -- like"
    assert dialect.translate("SELECT lpad(rpad(a, 2, ','), 3, '(')") == "SELECT py_lpad(py_rpad(a, 2, ','), 3, '(')"


def test_writes_in_a_session_with_staging(spark, tmp_path):
    t = TenantSession(spark, "acme", {"p": spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")}, staging=f"file://{tmp_path}")
    rows = lambda: sorted((tuple(r) for r in t.rows("SELECT * FROM p")), key=str)
    assert t.execute("INSERT INTO p (id) VALUES (3), (4)").affected == 2 and rows() == [(1, "a"), (2, None), (3, None), (4, None)]
    done = t.execute("UPDATE p SET v = ? WHERE id >= ? RETURNING id, v", ["it's", 3])
    assert done.affected == 2 and sorted(map(tuple, done.rows)) == [(3, "it's"), (4, "it's")]
    assert t.execute("DELETE FROM p WHERE v IS NULL").affected == 1 and t.execute("REPLACE INTO p VALUES (1, 'z')").affected == 1
    assert rows() == [(1, "z"), (3, "it's"), (4, "it's")]
    t.execute('CREATE TABLE IF NOT EXISTS "q" (id INTEGER PRIMARY KEY, x REAL, PRIMARY KEY (id))')
    t.execute("INSERT INTO q SELECT id, id / 2.0 FROM p")
    t.execute("ALTER TABLE q ADD COLUMN note TEXT")
    t.execute("ALTER TABLE q RENAME COLUMN x TO y")
    assert t.tables()["q"] == [("id", "bigint"), ("y", "double"), ("note", "string")] and t.rows("SELECT sum(y) AS s FROM q")[0]["s"] == 4.0
    t.execute("DROP TABLE q")
    assert sorted(t.tables_now()) == ["p"] and t.written == {"p", "q"}
    for bad, code in (("UPDATE other SET v = 1", "FILO_BLOCKED"), ("UPDATE p SET nope = 1", "SQLITE_ERROR"), ("DROP TABLE q", "SQLITE_ERROR"), ("CREATE VIEW x AS SELECT 1", "FILO_BLOCKED"), ("INSERT INTO p SELECT * FROM other", "FILO_BLOCKED"), ("INSERT INTO p VALUES (1)", "SQLITE_ERROR")):
        with pytest.raises(errors.TenantError) as e:
            t.execute(bad)
        assert e.value.code == code, bad
    with pytest.raises(errors.TenantError) as e:
        TenantSession(spark, "acme", {"p": spark.range(1)}).execute("DELETE FROM p")
    assert e.value.code == "FILO_READONLY"


def test_state_machines_keep_types_and_null_keys(spark):
    from quillon.streaming import processors

    big = 2**53
    rows = [(None, i, 0) for i in range(5)] + [(big, 0, 0), (big + 1, 1, 0), (big + 1, 2, 0), (big + 1, 3, None)]
    df = spark.createDataFrame(rows, "k long, seq long, at long").withColumn("at", F.coalesce("at", F.lit(0)))
    found = processors.over_table(df, "k", ["seq"], processors.FixedWindow(2, 10)).collect()
    assert sorted(((r["k"], r["seq"], r["allowed"]) for r in found), key=str) == sorted([(None, i, i < 2) for i in range(5)] + [(big, 0, True), (big + 1, 1, True), (big + 1, 2, True), (big + 1, 3, False)], key=str)
    refused = spark.createDataFrame([("w", 0, "a", False), ("w", 1, "b", False), ("w", 2, "a", True)], "k string, seq int, node string, ok boolean")
    assert [r["outcome"] for r in processors.over_table(refused, "k", ["seq"], processors.Quorum(3, 2)).orderBy("seq").collect()] == ["pending", "impossible", "impossible"]
    unknown = spark.createDataFrame([("w", 0, False), ("x", 0, True)], "k string, pos long, known boolean").selectExpr("*", "1L AS epoch", "0L AS gen", "7L AS salt", "5L AS size")
    assert {r["k"]: r["outcome"] for r in processors.over_table(unknown, "k", ["pos"], processors.LogApply()).collect()} == {"w": "unknown_shard", "x": "reset"}


def test_an_empty_publication_sweeps_its_owner(spark):
    from quillon.operators import upserts

    table = spark.createDataFrame([("n1", "a"), ("n2", "b")], "node string, s string")
    assert [tuple(r) for r in upserts.replaced_members(table, table.limit(0), "node", ["n1"]).collect()] == [("n2", "b")]
    jobs = spark.createDataFrame([("a", "done", dt.datetime(2024, 1, 1)), ("b", "pending", dt.datetime(2024, 1, 1)), ("c", "done", dt.datetime(2024, 2, 1))], "k string, state string, at timestamp_ntz")
    cut = dt.datetime(2024, 1, 15)
    assert sorted(r["k"] for r in upserts.pruned_terminal(jobs, "at", cut, ["done"]).collect()) == ["b", "c"]
    assert {r["k"]: r["state"] for r in upserts.expired(jobs, "at", cut).collect()}["b"] == "expired"
    assert {r["k"]: r["status"] for r in upserts.tombstoned(spark.createDataFrame([("a", "active")], "k string, status string"), spark.createDataFrame([("a",), ("z",)], "k string"), "k").collect()} == {"a": "deleted", "z": "deleted"}
