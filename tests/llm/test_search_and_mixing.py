import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import maxscore, mixing

VECTORS = "vec_id long, embedding array<float>, label int, terms string, score long"


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 64)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 4)
    r = np.random.RandomState(5)
    ids = [int(i) for i in r.permutation(700)]
    vectors = r.randn(700, 16) * r.rand(16) * 3
    vectors[50:300] = vectors[50]
    vectors[300:310] = 0
    vectors = vectors.astype(np.float32)
    rows = [(i, v.tolist(), 0, "t", 1) for i, v in zip(ids, vectors, strict=True)]
    rows += [(700, None, 0, "t", 1), (800, [None] * 16, 0, "t", 1), (900, [float("nan")] * 16, 0, "t", 1), (1000, [float("inf")] * 16, 0, "t", 1), (None, [1.0] * 16, 0, "t", 1)]
    found = maxscore.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0, 10).collect()
    terms = np.floor(1024 * vectors.astype(np.float64)).astype(np.int64)
    want = maxscore.pairs_by_definition(ids, terms, [k for k, i in enumerate(ids) if i % 20 == 0], 10)
    assert Counter(map(tuple, found)) == Counter(want)


def test_search_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "", 0), (1, [2.0, 3.0], 0, "", 0), (2, [], 0, "", 0)], VECTORS)
    found = maxscore.search(df, F.col("vec_id") == 0, 10).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 2 * 1024 * 1024), (2, 2, 0)]
    assert maxscore.search(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0, 10).collect() == []


def test_non_essential_terms_cannot_reach_the_threshold():
    bounds = np.array([9.0, 5, 3, 1])
    assert maxscore.essential_split(bounds, 4.5) == 2
    assert maxscore.essential_split(bounds, 100) == 0
    assert maxscore.essential_split(bounds, -np.inf) == 4


DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix_pass string, row string"


def docs(spark):
    rows = [(i, "w " * (1 + i % 37), "en", "big", 0, "p", "r") for i in range(900)]
    rows += [(1000 + i, "w " * 20, "en", "small", 0, "p", "r") for i in range(60)]
    rows += [(2000 + i, None if i % 2 else "", "en", None, None, None, None) for i in range(20)] + [(5, "same", "en", "one", 0, "p", "r")] * 40
    return spark.createDataFrame(rows, DOCS)


def test_every_document_is_dealt_once_and_none_over_the_limit(spark):
    found = mixing.schedule(docs(spark), repetition=2.0)
    per = Counter(r["doc_id"] for r in found.collect() if r["doc_id"] != 5)
    assert set(per) == {r["doc_id"] for r in docs(spark).collect()} - {5} and max(per.values()) <= 2
    assert Counter(r["doc_id"] for r in found.filter("source = 'small'").collect()).most_common(1)[0][1] == 2
    again = mixing.schedule(docs(spark), repetition=2.0)
    assert found.exceptAll(again).isEmpty() and again.exceptAll(found).isEmpty()


def test_quotas_follow_the_weights(spark):
    totals = {r["source"]: r["t"] for r in docs(spark).groupBy("source").agg(F.sum(mixing.tokens()).alias("t")).collect()}
    known = sorted(totals.items(), key=lambda r: (r[0] is not None, r[0] or ""))
    budget = 8000
    quota = {s: q for s, _, _, q in mixing.plan(known, budget, 1.2, 9)}
    got = mixing.schedule(docs(spark), budget=budget, target_entropy=1.2).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    for r in got:
        assert 0 <= quota[r["source"]] - r["t"] <= 40
    weights = [q / budget for q in quota.values()]
    assert abs(mixing.entropy(weights) - 1.2) < 0.01


@pytest.mark.parametrize("broadcast", [131_072, 0])
def test_dealt_rows_equal_a_plain_reckoning(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "PARTS", 3)
    df = docs(spark).union(docs(spark).filter("source = 'big'").limit(50))
    seed = 17
    h = F.xxhash64("doc_id", "text", F.lit(seed))
    plain = df.select("doc_id", "source", mixing.tokens().alias("t"), F.pmod(h, F.lit(4)).alias("block"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(3)).alias("part"), F.xxhash64(F.struct(*df.columns)).alias("row")).collect()
    hashes = {}

    def hashed(kind, *values):  # the engine's hash of a few values
        if (kind, values) not in hashes:
            typed = ", ".join("CAST(NULL AS STRING)" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {k})" for v, k in zip(values, kind, strict=True))
            hashes[kind, values] = spark.sql(f"SELECT xxhash64({typed}) AS h").first()["h"]
        return hashes[kind, values]

    want = Counter()
    totals = Counter()
    for r in plain:
        totals[r["source"]] += r["t"]
    known = sorted(totals.items(), key=lambda r: (r[0] is not None, r[0] or ""))
    budget = 9000
    for source, passes, beyond, _ in mixing.plan(known, budget, 1.1, 1.5):
        mine = [r for r in plain if r["source"] == source]
        for r in mine:
            for k in range(passes):
                want[r["doc_id"], k] += 1
        room = beyond
        order = sorted({r["block"] for r in mine}, key=lambda b: (hashed(("STRING", "INT", "BIGINT", "INT"), source, b, passes, seed), b))
        for b in order:
            rows = [r for r in mine if r["block"] == b]
            size = sum(r["t"] for r in rows)
            if room >= size:
                want.update((r["doc_id"], passes) for r in rows)
            elif room > 0:
                left = room
                for p in sorted({r["part"] for r in rows}, key=lambda p: (hashed(("STRING", "INT", "INT", "INT"), source, b, p, seed), p)):
                    some = [r for r in rows if r["part"] == p]
                    if left > 0:
                        used = 0
                        for r in sorted(some, key=lambda r: (hashed(("BIGINT", "BIGINT"), r["doc_id"], passes), r["doc_id"], r["row"])):
                            used += r["t"]
                            if used <= left:
                                want[r["doc_id"], passes] += 1
                    left -= sum(r["t"] for r in some)
            room -= size
    found = mixing.schedule(df, budget=budget, target_entropy=1.1).collect()
    assert Counter((r["doc_id"], r["pass_no"]) for r in found) == want and any(k for _, k in want)


def test_exponent_meets_entropy_and_repetition():
    totals = [1000, 100, 10]
    e, w = mixing.temperature(totals, 1110, target_entropy=0.8)
    assert 0 < e < 1 and abs(mixing.entropy(w) - 0.8) < 1e-6
    e, w = mixing.temperature(totals, 1110, repetition=3.0)
    assert abs(max(x * 1110 / t for x, t in zip(w, totals)) - 3) < 1e-6
    assert mixing.temperature(totals, 1110, target_entropy=math.log(3) + 1)[0] == 0.0


def test_mixed_documents_keep_their_columns(spark):
    out = mixing.mixed(docs(spark), repetition=1.5)
    assert out.columns == docs(spark).columns and out.count() >= docs(spark).count()
    assert mixing.mixed(spark.createDataFrame([], DOCS)).collect() == []
