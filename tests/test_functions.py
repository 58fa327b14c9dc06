"""The function library against the standard library of Python, whose meanings it has to have."""

import datetime as dt
import hashlib
import re
import zoneinfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import library, regex

ZONES = [None, "UTC", "America/New_York", "Asia/Tokyo", "Asia/Kolkata", "Pacific/Chatham", "Australia/Lord_Howe", "Europe/London"]
STAMPS = [
    "2024-01-01 00:00:00", "2023-12-31 23:59:59.999999", "2024-02-29 12:34:56.5", "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-03-31 01:30:00", "2024-10-27 01:30:00", "2024-04-07 02:15:00", "2024-10-06 02:15:00",
    "2021-01-03 10:00:00.1234567", "1999-06-15 05:06:07+02:00", "2020-12-28 08:09:10.000001",
]


@pytest.fixture(scope="module")
def call(spark):
    library.register(spark)

    def run(name, *rows):
        n = len(rows[0])
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"a{k} string" for k in range(n)))
        table.createOrReplaceTempView("calls")
        return [r["x"] for r in spark.sql(f"SELECT i, {name}({', '.join(f'a{k}' for k in range(n))}) AS x FROM calls").orderBy("i").collect()]

    return run


def fails(call, name, *args):
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|INVALID_TIMEZONE|UNKNOWN"):
        call(name, args)


def parse(text):
    d, t = text.split(" ")
    t = re.split("[-+]", t)[0]
    h, m, s = t.split(":")
    s, _, f = s.partition(".")
    return dt.datetime(*map(int, d.split("-")), int(h), int(m), int(s), int((f + "000000")[:6]))


def moved(value, tz, conn):
    if conn is None:
        return value
    aware = value.replace(tzinfo=zoneinfo.ZoneInfo(conn))
    out = aware.astimezone(dt.UTC).astimezone(zoneinfo.ZoneInfo(tz or conn)).replace(tzinfo=None)
    return out if tz and tz != conn else value if aware.astimezone(dt.UTC).astimezone(zoneinfo.ZoneInfo(conn)).replace(tzinfo=None) == value else None


GRID = [(s, tz, conn) for s in STAMPS for conn in (None, "UTC", "America/New_York") for tz in ZONES if conn or not tz]


def expected(f):
    return [None if (v := moved(parse(s), tz, conn)) is None else f(v) for s, tz, conn in GRID]


def compare(got, want):
    assert [(g, w) for g, w in zip(got, want, strict=True) if w is not None and g != w] == []


def test_extracts(call):
    parts = {
        "year": lambda v: v.year, "month": lambda v: v.month, "day": lambda v: v.day, "quarter": lambda v: (v.month + 2) // 3, "week": lambda v: v.isocalendar()[1], "iso_year": lambda v: v.isocalendar()[0],
        "week_day": lambda v: v.isoweekday() % 7 + 1, "iso_week_day": lambda v: v.isoweekday(), "hour": lambda v: v.hour, "minute": lambda v: v.minute, "second": lambda v: v.second, "microsecond": lambda v: v.microsecond,
    }
    for part, f in parts.items():
        compare(call("django_datetime_extract", *[(part, *g) for g in GRID]), expected(f))


def test_truncs(call):
    def start(unit, v):
        if unit == "week":
            return v.date() - dt.timedelta(v.weekday())
        return v.date().replace(month=1 if unit == "year" else v.month - (v.month - 1) % 3 if unit == "quarter" else v.month, day=v.day if unit == "day" else 1)

    for unit in ("year", "quarter", "month", "week", "day"):
        compare(call("django_date_trunc", *[(unit, *g) for g in GRID]), expected(lambda v, u=unit: str(start(u, v))))
        compare(call("django_datetime_trunc", *[(unit, *g) for g in GRID]), expected(lambda v, u=unit: f"{start(u, v)} 00:00:00"))
    for unit, cut in (("hour", "%H:00:00"), ("minute", "%H:%M:00"), ("second", "%H:%M:%S")):
        compare(call("django_datetime_trunc", *[(unit, *g) for g in GRID]), expected(lambda v, c=cut: v.strftime(f"%Y-%m-%d {c}")))
        compare(call("django_time_trunc", *[(unit, *g) for g in GRID]), expected(lambda v, c=cut: v.strftime(c)))


def test_casts(call):
    compare(call("django_datetime_cast_date", *GRID), expected(lambda v: str(v.date())))
    compare(call("django_datetime_cast_time", *GRID), expected(lambda v: v.time().isoformat()))


def test_null_and_error_rules(call):
    assert call("django_datetime_extract", ("year", None, None, None), ("year", "garbage", "UTC", "UTC"), ("year", "2024-13-01", None, None), ("year", "", None, None), (None, "2024-01-01", None, None)) == [None] * 5
    assert call("django_datetime_extract", ("year", "2024-05-06", None, None)) == [2024]
    fails(call, "django_datetime_extract", "hour", "2024-05-06", None, None)
    fails(call, "django_datetime_extract", "century", "2024-05-06", None, None)
    fails(call, "django_datetime_trunc", "day", "", "UTC", "UTC")
    fails(call, "django_datetime_trunc", "day", "2024-05-06", "UTC", "UTC")
    fails(call, "django_datetime_trunc", "day", "2024-05-06 00:00:00", "UTC", None)
    fails(call, "django_datetime_cast_date", "2024-05-06", None, None)
    fails(call, "django_datetime_trunc", "day", "2024-05-06 00:00:00", "UTC+5", "UTC")
    fails(call, "django_time_extract", "hour", "")
    fails(call, "django_time_diff", "x", "12:00:00")
    fails(call, "django_timestamp_diff", "2024-01-01", "2024-01-01 00:00:00")
    assert call("django_time_extract", ("hour", "25:00:00"), ("microsecond", "01:02:03.5")) == [None, 500000]
    assert call("django_timestamp_diff", ("2024-01-02", "2024-01-01"), (None, "2024-01-01")) == [86_400_000_000, None]


def test_zone_deltas(call):
    assert call("django_datetime_trunc", ("minute", "2024-05-06 10:00:00", "UTC+05:30", "UTC"), ("minute", "2024-05-06 10:00:00", "Asia/Tokyo-01:00", "UTC")) == ["2024-05-06 15:30:00", "2024-05-06 18:00:00"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(-(10**15), 10**15), min_size=20, max_size=20))
def test_durations_print_as_python_prints_them(spark, values):
    library.register(spark)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long")
    got = [r["x"] for r in df.selectExpr("i", "duration_text(v) AS x").orderBy("i").collect()]
    assert got == [str(dt.timedelta(microseconds=v)) for v in values]


def test_duration_arithmetic(spark):
    library.register(spark)
    one = lambda e: spark.sql(f"SELECT {e} AS x").first()["x"]
    assert one("dt_add('2024-02-28 23:59:59.5', 500000L)") == "2024-02-29 00:00:00"
    assert one("dt_sub('2024-03-01', 1L)") == "2024-03-01" and one("dt_sub('2024-03-01', -1L)") == "2024-03-02"
    assert one("dt_diff('2024-01-01', '2024-01-02')") == "-1 day, 0:00:00"
    assert one("dur_mul_int(6L, 7L)") == 42 and one("dur_div(8D, 2D)") == 4.0
    for bad in ("dur_mul_int(9223372036854775807L, 2L)", "dur_div(1D, 0D)"):
        with pytest.raises(Exception, match="OVERFLOW|USER_RAISED"):
            one(bad)


def test_padding_and_hashes(spark):
    library.register(spark)
    rows = [(t, n, f) for t in ("", "abc", "né", "😀x", "日本語") for n in range(-2, 8) for f in ("", "-", "*+", "é")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n int, f string")
    got = df.selectExpr("i", "py_lpad(t, n, f) AS l", "py_rpad(t, n, f) AS r", "py_repeat(t, n) AS p").orderBy("i").collect()
    for (t, n, f), g in zip(rows, got, strict=True):
        delta = n - len(t)
        left = t[:n] if delta <= 0 else (f * n)[:delta] + t
        assert (g["l"], g["r"], g["p"]) == (left, (t + f * n)[:n], t * n), (t, n, f)
    for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        assert spark.sql(f"SELECT {name}('né') AS x").first()["x"] == hashlib.new(name, "né".encode()).hexdigest()


PATTERNS = [r"abc$", r"abc\Z", r"^a", r"\d+", r"\w+é", r"(?i)É", r"(?P<w>\w)(?P=w)", r"(a)(b)?\1", r"a(?=b)", r"(?<!a)b", r"[[a]", r"[a&&b]", r"[^]a]", r"\s", r"a|b", r"a{2,3}", r"[\d\s]x", r"\bab\b", r"."]
SUBJECTS = ["", "abc", "abc\n", "abc\r\n", "xabc ", "aab", "é", "É", "aa", "a&b", "[", "]", " ", "\x1c", "١٢", "ab c", "\n", "1x", " x", "baa"]


def test_patterns_mean_what_they_mean_in_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SUBJECTS)], "i int, s string")
    columns = [regex.search(df["s"], p).alias(f"p{k}") for k, p in enumerate(PATTERNS)]
    for row in df.select("i", *columns).collect():
        for k, p in enumerate(PATTERNS):
            assert row[f"p{k}"] == (re.search(p, SUBJECTS[row["i"]]) is not None), (p, SUBJECTS[row["i"]])
    with pytest.raises(re.error):
        regex.translate("(")
