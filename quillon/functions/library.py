"""The SQL function library as temporary SQL functions, which Catalyst inlines into the plan.

Names and argument orders are those that tenant SQL calls. A text that is no date or time gives NULL or an
error as each function documents; ``raise_error`` within CASE is only evaluated where its branch is taken.
A parsed value is STRUCT<ts TIMESTAMP_NTZ, timed BOOLEAN>: a bare date is not midnight.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

VALUE = "STRUCT<ts: TIMESTAMP_NTZ, timed: BOOLEAN>"
DATE_RE = r"^\\s*[0-9]{1,4}\\s*-\\s*[0-9]{1,2}\\s*-\\s*[0-9]{1,2}\\s*$"
TIME_RE = r"^\\s*[0-9]{1,2}\\s*:\\s*[0-9]{1,2}\\s*:\\s*[0-9]{1,2}([.][0-9]*)?\\s*$"
DAY_US = 86_400_000_000
#: The form that nearly all values have, which a plain cast reads; others take the patterns.
CANONICAL = "length(s) IN (10, 19, 26) AND substring(s, 5, 1) = '-' AND substring(s, 8, 1) = '-' AND translate(s, '0123456789', '') IN ('--', '-- ::', '-- ::.')"


def _fail(message: str, kind: str) -> str:
    return f"CAST(raise_error('{message}') AS {kind})"


def _let(name: str, args: str, kind: str, bound: list[tuple[str, str, str]], body: str) -> list[tuple[str, str, str, str]]:
    """A function whose body may use the bound names; binding is by calling an inner function."""
    names = [x.split()[0] for x in args.split(", ") if x]
    inner = ", ".join([x for x in [args] if x] + [f"{n} {k}" for n, k, _ in bound])
    call = ", ".join(names + [e for _, _, e in bound])
    return [(f"{name}_in", inner, kind, body.replace("raise!", _fail("unsupported lookup or value", kind))), (name, args, kind, f"{name}_in({call})")]


def _times(lookup_of: dict[str, str], timed: set[str], kind: str) -> str:
    """CASE over lookups; those in ``timed`` are errors for a bare date."""
    cases = " ".join(f"WHEN lookup = '{k}' THEN " + (f"CASE WHEN v.timed THEN {e} ELSE raise! END" if k in timed else e) for k, e in lookup_of.items())
    return f"CASE WHEN lookup IS NULL OR v IS NULL THEN NULL {cases} ELSE raise! END"


DATE_TRUNCS = {unit: f"date_format(date_trunc('{unit}', v.ts), 'yyyy-MM-dd')" for unit in ("year", "quarter", "month", "week", "day")}
STAMP_TRUNCS = {unit: f"date_format(date_trunc('{unit}', v.ts), 'yyyy-MM-dd HH:mm:ss')" for unit in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")}
MICROS_OF_DAY = "(hour({0}) * 3600L + minute({0}) * 60L + CAST(floor(extract(SECOND FROM {0})) AS BIGINT)) * 1000000L + CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT) % 1000000L"
EXTRACTS = {
    "year": "year(v.ts)",
    "month": "month(v.ts)",
    "day": "day(v.ts)",
    "quarter": "quarter(v.ts)",
    "week": "weekofyear(v.ts)",
    "iso_year": "extract(YEAROFWEEK FROM v.ts)",
    "week_day": "dayofweek(v.ts)",
    "iso_week_day": "weekday(v.ts) + 1",
    "hour": "hour(v.ts)",
    "minute": "minute(v.ts)",
    "second": "CAST(floor(extract(SECOND FROM v.ts)) AS INT)",
    "microsecond": "CAST(CAST(extract(SECOND FROM v.ts) * 1000000 AS BIGINT) % 1000000 AS INT)",
}
CLOCK = {"hour", "minute", "second", "microsecond"}
CLOCK_TEXT = "concat(lpad(us div 3600000000, 2, '0'), ':', lpad(us div 60000000 % 60, 2, '0'), ':', lpad(us div 1000000 % 60, 2, '0'), IF(us % 1000000 = 0, '', concat('.', lpad(us % 1000000, 6, '0'))))"

#: name, arguments, result type, body; later ones may call earlier ones.
SHIFTED = "timestampadd(MICROSECOND, {1}, {0})"
DT, PAIR = "lookup STRING, dt STRING, tz STRING, conn STRING", "dt STRING, tz STRING, conn STRING"
V = [("v", VALUE, "q_value(dt, tz, conn)")]

#: name, arguments, result type, body; later ones may call earlier ones.
DATETIME = [
    # a year under four digits is filled up, as the cast asks for four
    *_let("q_date_text", "s STRING", "STRING", [("d", "STRING", f"CASE WHEN s rlike '{DATE_RE}' THEN translate(s, ' \\t\\n\\r', '') END")], "lpad(d, length(d) + greatest(5 - instr(d, '-'), 0), '0')"),
    ("q_date", "s STRING", "DATE", "TRY_CAST(q_date_text(s) AS DATE)"),
    ("q_clock_only", "t STRING", "STRING", f"CASE WHEN t rlike '{TIME_RE}' THEN rtrim('.', translate(t, ' \\t\\n\\r', '')) END"),
    *_let(
        "q_clock", "s STRING", "BIGINT", [("p", "ARRAY<STRING>", f"CASE WHEN s rlike '{TIME_RE}' THEN split(s, ':') END")],
        "CASE WHEN length(s) = 8 AND translate(s, '0123456789', '') = '::' AND substring(s, 3, 1) = ':' AND substring(s, 6, 1) = ':' THEN "
        "CASE WHEN left(s, 2) < '24' AND substring(s, 4, 2) < '60' AND right(s, 2) < '60' THEN ((CAST(left(s, 2) AS BIGINT) * 60 + CAST(substring(s, 4, 2) AS BIGINT)) * 60 + CAST(right(s, 2) AS BIGINT)) * 1000000L END "
        "WHEN CAST(trim(p[0]) AS INT) < 24 AND CAST(trim(p[1]) AS INT) < 60 AND CAST(substring_index(trim(p[2]), '.', 1) AS INT) < 60 THEN ((CAST(trim(p[0]) AS BIGINT) * 60 + CAST(trim(p[1]) AS BIGINT)) * 60 + CAST(substring_index(trim(p[2]), '.', 1) AS BIGINT)) * 1000000L "
        "+ IF(instr(p[2], '.') = 0, 0L, CAST(rpad(left(substring_index(trim(p[2]), '.', -1), 6), 6, '0') AS BIGINT)) END",
    ),
    ("q_offset_cut", "t STRING", "STRING", "CASE WHEN instr(t, '-') > 0 THEN left(t, instr(t, '-') - 1) WHEN instr(t, '+') > 0 THEN left(t, instr(t, '+') - 1) ELSE t END"),
    *_let(
        "q_stamp", "s STRING", VALUE,
        [("ts", "TIMESTAMP_NTZ", f"CASE WHEN {CANONICAL} THEN TRY_CAST(s AS TIMESTAMP_NTZ) ELSE TRY_CAST(IF(instr(s, ' ') = 0, q_date_text(s), concat(q_date_text(left(s, instr(s, ' ') - 1)), ' ', q_clock_only(q_offset_cut(substring(s, instr(s, ' ') + 1))))) AS TIMESTAMP_NTZ) END")],
        "IF(ts IS NULL, NULL, named_struct('ts', ts, 'timed', instr(s, ' ') > 0))",
    ),
    (
        "q_zone_delta", "tz STRING", "STRUCT<name: STRING, us: BIGINT>",
        "CASE WHEN tz rlike '^.*[+][0-9]{1,2}:[0-9]{1,2}$' THEN named_struct('name', regexp_extract(tz, '^(.*)[+]', 1), 'us', (CAST(regexp_extract(tz, '[+]([0-9]+):([0-9]+)$', 1) AS BIGINT) * 60 + CAST(regexp_extract(tz, '[+]([0-9]+):([0-9]+)$', 2) AS BIGINT)) * 60000000) "
        "WHEN tz rlike '^.*[-][0-9]{1,2}:[0-9]{1,2}$' THEN named_struct('name', regexp_extract(tz, '^(.*)[-]', 1), 'us', -(CAST(regexp_extract(tz, '[-]([0-9]+):([0-9]+)$', 1) AS BIGINT) * 60 + CAST(regexp_extract(tz, '[-]([0-9]+):([0-9]+)$', 2) AS BIGINT)) * 60000000) "
        "ELSE named_struct('name', tz, 'us', 0L) END",
    ),
    *_let(
        "q_value", "s STRING, tz STRING, conn STRING", VALUE,
        [("p", VALUE, "q_stamp(s)"), ("z", "STRUCT<name: STRING, us: BIGINT>", "q_zone_delta(tz)"), ("zoned", "BOOLEAN", "(coalesce(conn, '') <> '' OR (tz IS NOT NULL AND NOT tz <=> conn))")],
        f"CASE WHEN s IS NULL THEN NULL WHEN NOT zoned THEN p WHEN s = '' THEN {_fail('an empty text has no time zone', VALUE)} WHEN p IS NULL THEN NULL WHEN NOT p.timed THEN {_fail('a date value has no time zone', VALUE)} "
        f"WHEN coalesce(conn, '') = '' THEN {_fail('a naive value cannot be converted', VALUE)} WHEN z.name rlike '^(UTC|GMT|UT)?[+-]' OR conn rlike '^(UTC|GMT|UT)?[+-]' THEN {_fail('unknown time zone', VALUE)} "
        "WHEN tz IS NULL OR tz = conn THEN named_struct('ts', convert_timezone(conn, conn, p.ts), 'timed', true) "
        f"ELSE named_struct('ts', convert_timezone('UTC', z.name, {SHIFTED.format("convert_timezone(conn, 'UTC', p.ts)", 'z.us')}), 'timed', true) END",
    ),
    ("q_clock_text", "us BIGINT", "STRING", CLOCK_TEXT),
    ("q_micros", "ts TIMESTAMP_NTZ", "BIGINT", MICROS_OF_DAY.format("ts")),
    *_let("django_date_trunc", DT, "STRING", V, _times(DATE_TRUNCS, set(), "STRING")),
    *_let("django_datetime_trunc", DT, "STRING", V, _times(STAMP_TRUNCS, CLOCK, "STRING")),
    *_let("django_datetime_extract", DT, "BIGINT", V, _times({k: f"CAST({e} AS BIGINT)" for k, e in EXTRACTS.items()}, CLOCK, "BIGINT")),
    ("django_date_extract", "lookup STRING, dt STRING", "BIGINT", "django_datetime_extract(lookup, dt, NULL, NULL)"),
    *_let("django_datetime_cast_date", PAIR, "STRING", V, "CASE WHEN v IS NULL THEN NULL WHEN v.timed THEN date_format(v.ts, 'yyyy-MM-dd') ELSE raise! END"),
    *_let("django_datetime_cast_time", PAIR, "STRING", V, "CASE WHEN v IS NULL THEN NULL WHEN v.timed THEN q_clock_text(q_micros(v.ts)) ELSE raise! END"),
    ("q_cut_clock", "lookup STRING, us BIGINT", "STRING", f"CASE lookup WHEN 'hour' THEN q_clock_text(us - us % 3600000000) WHEN 'minute' THEN q_clock_text(us - us % 60000000) WHEN 'second' THEN q_clock_text(us - us % 1000000) ELSE {_fail('unsupported lookup', 'STRING')} END"),
    *_let(
        "django_time_trunc", DT, "STRING", [*V, ("us", "BIGINT", "q_clock(dt)")],
        "CASE WHEN lookup IS NULL OR dt IS NULL THEN NULL WHEN v IS NOT NULL THEN CASE WHEN v.timed THEN q_cut_clock(lookup, q_micros(v.ts)) ELSE raise! END WHEN dt = '' THEN raise! WHEN us IS NULL THEN NULL ELSE q_cut_clock(lookup, us) END",
    ),
    *_let(
        "django_time_extract", "lookup STRING, t STRING", "BIGINT", [("us", "BIGINT", "q_clock(t)")],
        "CASE WHEN lookup IS NULL OR t IS NULL THEN NULL WHEN t = '' THEN raise! WHEN us IS NULL THEN NULL ELSE CASE lookup WHEN 'hour' THEN us div 3600000000 WHEN 'minute' THEN us div 60000000 % 60 WHEN 'second' THEN us div 1000000 % 60 WHEN 'microsecond' THEN us % 1000000 ELSE raise! END END",
    ),
    *_let("q_clock_strict", "t STRING", "BIGINT", [("us", "BIGINT", "q_clock(t)")], "CASE WHEN us IS NULL THEN raise! ELSE us END"),
    ("django_time_diff", "l STRING, r STRING", "BIGINT", "CASE WHEN l IS NULL OR r IS NULL THEN NULL ELSE q_clock_strict(l) - q_clock_strict(r) END"),
    *_let(
        "django_timestamp_diff", "l STRING, r STRING", "BIGINT", [("a", VALUE, "q_stamp(l)"), ("b", VALUE, "q_stamp(r)")],
        "CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN a IS NULL OR b IS NULL OR a.timed <> b.timed THEN raise! ELSE timestampdiff(MICROSECOND, b.ts, a.ts) END",
    ),
    *_let(
        "duration_text", "us BIGINT", "STRING", [("r", "BIGINT", f"pmod(us, {DAY_US}L)"), ("d", "BIGINT", f"(us - pmod(us, {DAY_US}L)) div {DAY_US}L")],
        "concat(CASE WHEN d = 0 THEN '' WHEN abs(d) = 1 THEN concat(d, ' day, ') ELSE concat(d, ' days, ') END, r div 3600000000, ':', lpad(r div 60000000 % 60, 2, '0'), ':', lpad(r div 1000000 % 60, 2, '0'), IF(r % 1000000 = 0, '', concat('.', lpad(r % 1000000, 6, '0'))))",
    ),
    *_let("stamp_text", "ts TIMESTAMP_NTZ", "STRING", [("f", "BIGINT", "q_micros(ts) % 1000000")], "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), IF(f = 0, '', concat('.', lpad(f, 6, '0'))))"),
    ("duration_add", "l BIGINT, r BIGINT", "STRING", "duration_text(l + r)"),
    ("duration_sub", "l BIGINT, r BIGINT", "STRING", "duration_text(l - r)"),
    *(
        step
        for name, sign, shift in (("dt_add", "", "date_add"), ("dt_sub", "-", "date_sub"))
        for step in _let(
            name, "dt STRING, us BIGINT", "STRING", [("p", VALUE, "q_stamp(dt)")],
            f"CASE WHEN p IS NULL OR us IS NULL THEN NULL WHEN p.timed THEN stamp_text({SHIFTED.format('p.ts', sign + 'us')}) ELSE date_format({shift}(CAST(p.ts AS DATE), CAST((us - pmod(us, {DAY_US}L)) div {DAY_US}L AS INT)), 'yyyy-MM-dd') END",
        )
    ),
    ("dt_diff", "l STRING, r STRING", "STRING", "duration_text(django_timestamp_diff(l, r))"),
    # sums of what may each be a duration (microseconds) or a time in text
    ("q_dtdelta_add", "l STRING, l_text BOOLEAN, r STRING, r_text BOOLEAN", "STRING", "CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN l_text AND r_text THEN NULL WHEN l_text THEN dt_add(l, CAST(r AS BIGINT)) WHEN r_text THEN dt_add(r, CAST(l AS BIGINT)) ELSE duration_text(CAST(l AS BIGINT) + CAST(r AS BIGINT)) END"),
    ("q_dtdelta_sub", "l STRING, l_text BOOLEAN, r STRING, r_text BOOLEAN", "STRING", "CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN l_text AND r_text THEN dt_diff(l, r) WHEN l_text THEN dt_sub(l, CAST(r AS BIGINT)) WHEN r_text THEN NULL ELSE duration_text(CAST(l AS BIGINT) - CAST(r AS BIGINT)) END"),
    ("dur_mul_int", "l BIGINT, r BIGINT", "BIGINT", "l * r"),
    ("dur_mul", "l DOUBLE, r DOUBLE", "DOUBLE", "l * r"),
    ("dur_div", "l DOUBLE, r DOUBLE", "DOUBLE", f"CASE WHEN r = 0 THEN {_fail('division by zero', 'DOUBLE')} ELSE l / r END"),
]

#: A format's directives, each a split of the format at its sign: the text before, the value, the text after.
_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}
STRFTIME = "f"
for _sign, _pattern in _DIRECTIVES.items():
    STRFTIME = f"replace({STRFTIME}, '{_sign}', date_format(ts, '{_pattern}'))"
STRFTIME = f"replace(replace(replace(replace({STRFTIME}, '%j', lpad(dayofyear(ts), 3, '0')), '%w', CAST(dayofweek(ts) - 1 AS STRING)), '%f', concat(date_format(ts, 'ss'), '.', date_format(ts, 'SSS'))), '%s', CAST(unix_micros(CAST(ts AS TIMESTAMP)) div 1000000 AS STRING))"

TEXT = [
    ("py_lpad", "t STRING, n INT, fill STRING", "STRING", "CASE WHEN n < 0 THEN IF(fill IS NULL, NULL, left(t, greatest(length(t) + n, 0))) WHEN n <= length(t) THEN IF(fill IS NULL, NULL, left(t, n)) ELSE lpad(t, n, fill) END"),
    ("py_rpad", "t STRING, n INT, fill STRING", "STRING", "CASE WHEN n < 0 THEN IF(fill IS NULL, NULL, left(t, greatest(length(t) + n, 0))) ELSE rpad(t, n, fill) END"),
    ("py_repeat", "t STRING, n INT", "STRING", "repeat(t, greatest(n, 0))"),
    ("sha224", "t STRING", "STRING", "sha2(CAST(t AS BINARY), 224)"),
    ("sha256", "t STRING", "STRING", "sha2(CAST(t AS BINARY), 256)"),
    ("sha384", "t STRING", "STRING", "sha2(CAST(t AS BINARY), 384)"),
    ("sha512", "t STRING", "STRING", "sha2(CAST(t AS BINARY), 512)"),
    ("bitxor", "x BIGINT, y BIGINT", "BIGINT", "x ^ y"),
    ("uuidv4", "", "STRING", "replace(uuid(), '-', '')"),
    # the time, and random bits of two random ids, the second with its variant
    ("uuidv7", "", "STRING", "concat(lpad(lower(hex(unix_millis(current_timestamp()))), 12, '0'), '7', substring(replace(uuid(), '-', ''), 14, 3), substring(replace(uuid(), '-', ''), 17))"),
    ("sqlite_lower", "t STRING", "STRING", "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    ("sqlite_upper", "t STRING", "STRING", "translate(t, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"),
    ("sqlite_quote", "t STRING", "STRING", "coalesce(concat('\\'', replace(t, '\\'', '\\'\\''), '\\''), 'NULL')"),
    ("sqlite_random", "", "BIGINT", "CAST((rand() - 0.5) * 18446744073709549568 AS BIGINT)"),
    ("sqlite_strftime", "f STRING, ts TIMESTAMP_NTZ", "STRING", STRFTIME),
    ("sqlite_kind", "kind STRING, absent BOOLEAN", "STRING", "CASE WHEN absent THEN 'null' WHEN kind IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN kind = 'binary' THEN 'blob' WHEN kind = 'double' OR kind = 'float' OR kind LIKE 'decimal%' THEN 'real' ELSE 'text' END"),
    ("randomblob", "n INT", "BINARY", "substring(unhex(array_join(transform(sequence(1, greatest(1, (n + 15) div 16)), i -> sha2(CAST(concat(i, uuid()) AS BINARY), 256)), '')), 1, greatest(1, n))"),
    ("like_escape", "t STRING", "STRING", r"replace(replace(replace(t, '\\', '\\\\'), '%', '\\%'), '_', '\\_')"),
]

#: Outside their domain these are NULL, not NaN; a zero divisor gives NULL.
MATH = [
    *((f"sqlite_{f}", "x DOUBLE", "DOUBLE", f"CASE WHEN isnan({f}(x)) OR abs({f}(x)) = DOUBLE('Infinity') THEN NULL ELSE {f}(x) END") for f in ("acos", "asin", "atan", "cos", "sin", "tan", "exp", "ln", "sqrt", "degrees", "radians")),
    ("sqlite_cot", "x DOUBLE", "DOUBLE", "CASE WHEN x = 0 THEN NULL ELSE 1 / tan(x) END"),
    ("sqlite_log", "b DOUBLE, x DOUBLE", "DOUBLE", "CASE WHEN b <= 0 OR b = 1 OR x <= 0 THEN NULL ELSE ln(x) / ln(b) END"),
    ("sqlite_power", "x DOUBLE, y DOUBLE", "DOUBLE", "nanvl(power(x, y), NULL)"),
    ("sqlite_sign", "x DOUBLE", "INT", "CAST(sign(x) AS INT)"),
    ("sqlite_mod", "x BIGINT, y BIGINT", "BIGINT", "try_mod(x, y)"),
    ("sqlite_div", "x BIGINT, y BIGINT", "BIGINT", "CASE WHEN y = 0 THEN NULL ELSE x div y END"),
]

ALL = [*DATETIME, *TEXT, *MATH]


_known: set[str] = set()


def register(spark: SparkSession) -> SparkSession:
    """Make every function of the library known to the session; a session that has them is left alone."""
    session = spark._jsparkSession.sessionUUID()
    if session not in _known:
        for name, args, kind, body in ALL:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
        _known.add(session)
    return spark
