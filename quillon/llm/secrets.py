"""Secret scan whose findings pass a random forest that removes false positives.

Runs of key-like characters are candidates. A forest judges each from its length, character transitions,
dictionary coverage, place in a path and neighbouring words. It is fitted on the driver from a bounded set of
labelled findings (``TRAINING`` rows at most) and written out as SQL, so that scanning uses DataFrame functions
only and moves no data: a text is split at its candidates into an array once, and features and verdicts
are made over that array, in time linear in the text.

Edge cases: null texts have no findings and stay null; empty texts too; the control characters U+0001 and
U+0002, which mark candidates within the split, count as spaces, and a redacted text has spaces for them; equal
candidates of a text are findings each, told apart by their ordinal; rows that repeat repeat their
findings; extra columns pass through redacted(); empty tables give empty results.
"""

from __future__ import annotations

import base64
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings that a forest is fitted on, at most.
TRAINING = 6000
TREES, DEPTH, LEAF = 15, 6, 8
CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"
NEAR = 48
MASK = "[SECRET]"
#: Short words and word parts that prose and identifiers are made of.
DICTIONARY = (
    "the and ing ion tion ent ment for her that with this from have are was not all can able ble ness ity ous ive ed er es en in on at re "
    "der die das und ein sch ich ung keit heit lich ver ge be zu auf aus mit von tz pf "
    "le la les des que une pour eau aux ier oi elle tre est pas vi "
    "el los del por una con ado ar os as ci cion mente rr ll ez ja bo "
    "test user name value data file path line time type list code page link index table class function return "
    "example sample default config version build project http https www com org html"
).split()
FEATURES = {
    "len": "length(x.c)",
    "transitions": r"(length(regexp_replace(x.c, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])', ' ')) - length(x.c)) / length(x.c)",
    "digits": "length(regexp_replace(x.c, '[^0-9]', '')) / length(x.c)",
    "uppers": "length(regexp_replace(x.c, '[^A-Z]', '')) / length(x.c)",
    "dictionary": "1 - length(regexp_replace(lower(x.c), '{words}', '')) / length(x.c)",
    "distinct": "size(array_distinct(split(x.c, ''))) / length(x.c)",
    "path": r"length(regexp_replace(x.c, '[^/]', '')) + IF(x.b rlike '[/.\\\\]$' OR x.a rlike '^[/.\\\\][A-Za-z]', 2, 0)",
    "hint": "IF(x.b rlike '(?i)(secret|token|passw|pwd|api.?key|access.?key|auth|bearer|credential|private)[^\\\\n]{0,24}$', 1, 0)",
    "assigned": "IF(x.b rlike '[=:]\\\\s{0,3}[\"\\']?$', 1, 0)",
    "benign": "IF(concat(x.b, ' ', x.a) rlike '(?i)\\\\b(sha|sha1|sha256|md5|checksum|commit|digest|uuid|hash|revision|etag|example|dummy|placeholder)\\\\b', 1, 0)",
}


def _features() -> str:
    words = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    return ", ".join(f"'{name}', CAST({sql.replace('{words}', words)} AS DOUBLE)" for name, sql in FEATURES.items())


def labelled_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(text before, candidate, text after, 1 for a secret): generated findings of known kinds."""
    r = random.Random(seed)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    prose = lambda k: "".join(r.choice(DICTIONARY[:90]) for _ in range(k))
    words = lambda: " ".join(prose(r.randrange(1, 4)) for _ in range(r.randrange(1, 6)))
    name = lambda: r.choice(["token", "secret", "password", "api_key", "auth_token", "access_key", "credential"])
    sign = lambda: r.choice([" = ", "=", ": ", ":", ' = "', '="', ': "', " = '"])
    random_key = lambda: r.choice(
        [
            lambda: pick("0123456789abcdef", r.choice([32, 40, 40, 64])),
            lambda: pick(alphabet, r.randrange(20, 48)),
            lambda: base64.b64encode(r.randbytes(r.randrange(15, 40))).decode(),
            lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "AKIA", "glpat-"]) + pick(alphabet, r.randrange(16, 40)),
        ]
    )()
    out = []
    for i in range(min(n, TRAINING)):
        if i % 2:
            kind = r.random()
            if kind < 0.85:
                s = sign()
                before, candidate, after = f"{words()} {name()}{s}", random_key(), s[-1] if s[-1] in "\"'" else " "
            elif kind < 0.93:
                before, candidate, after = f"{words()} Authorization: Bearer ", random_key(), " "
            else:
                before, candidate, after = words() + " ", r.choice(["ghp_", "sk_live_", "AKIA"]) + pick(alphabet, 36), " "
            out.append((before, candidate, f"{after} {words()}", 1))
        else:
            kind = r.random()
            if kind < 0.45:
                candidate = (prose(12) + prose(12))[: r.randrange(16, 40)]
                before, after = words() + r.choice([" ", " ", "\n", " token ", " the secret of "]), r.choice([" ", ". ", ", ", "\n"])
                candidate = candidate.capitalize() if r.random() < 0.2 else candidate
            elif kind < 0.6:
                candidate = "_".join(prose(2) for _ in range(4)) if r.random() < 0.5 else "".join(prose(2).capitalize() for _ in range(4))
                before, after = f"{words()} {name() if r.random() < 0.4 else prose(1)}{sign()}", "( "
            elif kind < 0.75:
                candidate = "/".join(prose(r.randrange(1, 3)) for _ in range(5))
                before, after = r.choice(["https://", "/", "see ./", "path "]), r.choice([".html ", "/ ", ".py "])
            elif kind < 0.87:
                candidate = pick("0123456789abcdef", r.choice([32, 40, 64]))
                before, after = f"{words()} {r.choice(['commit', 'sha256', 'md5', 'checksum', 'digest', 'etag'])}{r.choice([' ', ': ', '='])}", " "
            elif kind < 0.97:
                candidate = pick("0123456789", r.randrange(16, 20))
                before, after = words() + " ", r.choice([" ", ". "])
            else:
                candidate = r.choice(["x", "a", "0", "-", "_", "A1"]) * r.randrange(16, 30)
                before, after = f"{words()} {r.choice([name(), prose(2)])}{sign()}", " "
            out.append((before, candidate.ljust(16, "e"), f"{after}{words()}", 0))
    return out


def grow_tree(x: np.ndarray, y: np.ndarray, r: np.random.RandomState, depth: int) -> tuple | float:
    """(feature, cut, tree up to the cut, tree above it), or the share of secrets in a leaf."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return round(float(y.mean()), 6)
    best = (y.var() * len(y) - 1e-9, None, None)
    for j in r.permutation(x.shape[1])[: max(2, int(np.sqrt(x.shape[1]) + 1))]:
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= LEAF) & (n[:-1] <= len(y) - LEAF))
        if len(ok):
            left, k = s[ok], n[ok]
            right, m = s[-1] - left, len(y) - k
            impurity = left * (1 - left / k) + right * (1 - right / m)
            at = int(np.argmin(impurity))
            if impurity[at] < best[0]:
                best = (impurity[at], j, (v[ok[at]] + v[ok[at] + 1]) / 2)
    if best[1] is None:
        return round(float(y.mean()), 6)
    below = x[:, best[1]] <= best[2]
    return int(best[1]), float(best[2]), grow_tree(x[below], y[below], r, depth - 1), grow_tree(x[~below], y[~below], r, depth - 1)


def fit_forest(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list:
    r = np.random.RandomState(seed)
    trees = []
    for _ in range(TREES):
        rows = r.randint(len(y), size=len(y))
        trees.append(grow_tree(x[rows], y[rows].astype(float), r, DEPTH))
    return trees


def tree_sql(tree: tuple | float, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    j, cut, low, high = tree
    return f"IF(f.{names[j]} <= {cut!r}D, {tree_sql(low, names)}, {tree_sql(high, names)})"


def forest_sql(trees: list) -> str:
    """The mean of the trees over a struct ``f`` of features."""
    return "(" + " + ".join(tree_sql(t, list(FEATURES)) for t in trees) + f") / {len(trees)}D"


def features_of(findings: DataFrame) -> DataFrame:
    """Features of rows b, c, a (text before, candidate, text after), beside the other columns."""
    return findings.withColumn("x", F.struct("b", "c", "a")).withColumn("f", F.expr(f"named_struct({_features()})")).drop("x", "b", "c", "a")


def train(spark: SparkSession, labelled: DataFrame | None = None) -> str:
    """Fit the forest; returns its SQL. labelled: b, c, a, is_secret; by default generated findings."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_findings(), "b string, c string, a string, is_secret int")
    rows = features_of(labelled.select("b", "c", "a", "is_secret")).limit(TRAINING).collect()
    x = np.array([[float(v) for v in r["f"]] for r in rows])
    return forest_sql(fit_forest(x, np.array([r["is_secret"] for r in rows])))


def judged(docs: DataFrame, forest: str, text: str = "text") -> DataFrame:
    """Beside the own columns: scan_pieces, the text split before each candidate, and scan_found, a struct (c, score) per candidate."""
    marked = F.regexp_replace(F.translate(F.col(text), "\x01\x02", "  "), f"({CANDIDATE})", "\x01$1\x02")
    split = docs.withColumn("scan_pieces", F.split(marked, "\x01"))
    near = f"""transform(slice(scan_pieces, 2, greatest(size(scan_pieces) - 1, 0)), (p, i) -> struct(
        right(translate(scan_pieces[i], '\x02', ' '), {NEAR}) AS b, substring_index(p, '\x02', 1) AS c, left(substring(p, length(substring_index(p, '\x02', 1)) + 2), 24) AS a))"""
    featured = f"transform({near}, x -> named_struct('c', x.c, {_features()}))"
    return split.withColumn("scan_found", F.expr(f"transform({featured}, f -> named_struct('c', f.c, 'score', {forest}))"))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, ordinal (from 0), length, candidate_sha256, preview, score, is_secret."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = judged(narrow, train(docs.sparkSession, labelled)).select("doc_id", F.posexplode("scan_found").alias("ordinal", "found"))
    c = F.col("found.c")
    return found.select(
        "doc_id", "ordinal", F.length(c).alias("length"), F.sha2(c.cast("binary"), 256).alias("candidate_sha256"), F.concat(F.left(c, F.lit(4)), F.lit("...")).alias("preview"), F.round("found.score", 6).alias("score"), (F.col("found.score") >= 0.5).alias("is_secret")
    )


def redacted(docs: DataFrame, labelled: DataFrame | None = None, length_column: str | None = None) -> DataFrame:
    """The documents with every confirmed secret replaced by MASK; length_column, if given, gets the new length."""
    plain = docs.toDF(*(f"c_{i}" for i in range(len(docs.columns))))
    place = {name: f"c_{i}" for i, name in enumerate(docs.columns)}
    text = place["text"]
    found = judged(plain, train(docs.sparkSession, labelled), text)
    masked = f"""array_join(transform(scan_pieces, (p, i) -> IF(i > 0 AND scan_found[greatest(i - 1, 0)].score >= 0.5,
        concat('{MASK}', substring(p, length(substring_index(p, '\x02', 1)) + 2)), replace(p, '\x02', ''))), '')"""
    any_secret = F.exists("scan_found", lambda f: f["score"] >= 0.5)
    found = found.withColumn("scan_text", F.when(any_secret, F.expr(masked)).otherwise(F.col(text)))
    columns = {name: F.col("scan_text") if name == "text" else F.when(any_secret, F.length("scan_text").cast(docs.schema[name].dataType)).otherwise(F.col(p)) if name == length_column else F.col(p) for name, p in place.items()}
    return found.select(*(c.alias(name) for name, c in columns.items()))
