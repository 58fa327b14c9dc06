"""Exact top-k inner-product search with MaxScore over shards of quantised vectors.

A term is a component; its weight in a row is how far the row's value lies above the shard's smallest
product with the query, so weights are never negative and each term has an upper bound in the shard. Terms
are sorted by bound. Those whose bounds together cannot lift a row past the current k-th score are
non-essential. Essential terms are traversed for all rows of the shard, the others are probed a few at a
time and only for rows that still compete. Shards and blocks of queries meet in a grid, so that neither is
ever held whole, and the best of each shard are merged.

Shards are searched in rounds, each with three times as many as all before it, and a query takes its k-th score so far
into the next round as its threshold. So a round gives few rows a query beyond the first k, and the merged rows grow with
the logarithm of the number of shards.

Edge cases: null vectors, and vectors holding null or non-finite components, take no part, neither as query
nor as candidate; empty vectors are rows without terms (score 0); vectors of unequal length are padded with
zeros; very long ones cost memory in proportion, a shard's rows and a block's queries at a time; ties go to the smaller
vec_id; rows that repeat a vec_id are candidates each, and no query meets a row with its own id; a null vec_id takes no
part; columns other than vec_id and embedding are not used, so clashing names do no harm; an empty table gives an empty
result. Scores must stay under 2**53 (they are exact below it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, session

#: Queries in a block and rows in a shard of the grid; a vector is copied once for each block.
QUERY_BLOCK = 32768
SHARD_ROWS = 16384
#: Shards up to a round's end, over those up to the end of the round before.
GROWTH = 4
PROBE = 8
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and terms (array<bigint>): floor(1024 x) of every component, of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 1024).cast("long")).alias("terms")
    )


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def essential_split(bounds: np.ndarray, threshold: float) -> int:
    """How many of the terms, sorted by falling bound, are essential: the others' bounds together stay below the threshold."""
    rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0.0]])
    return int(np.argmax(rest < threshold)) if threshold > 0 else len(bounds)


def search_shard(query: np.ndarray, query_id: int, ids: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows (ids, scores) of a shard for one query, none below the score known; columns holds a term a row, ids ascend."""
    worst = np.where(query > 0, query * low, query * high)
    bounds = np.where(query > 0, query * high, query * low) - worst
    base = worst.sum()
    order = np.argsort(-bounds, kind="stable")
    query, bounds, worst = query[order], bounds[order], worst[order]
    own = ids == query_id
    head = np.flatnonzero(~own)[: max(64, 4 * k)]
    exact = columns[order][:, head].T @ query
    threshold = max(known, np.sort(exact)[-k] if len(exact) >= k else -np.inf)
    cut = essential_split(bounds, threshold - base)
    rest = np.concatenate([np.cumsum((bounds + worst)[::-1])[::-1], [0.0]])
    partial = query[:cut] @ columns[order[:cut]]
    alive = np.flatnonzero((partial + rest[cut] >= threshold) & ~own)
    partial = partial[alive]
    while cut < len(query) and len(alive):
        upto = min(len(query), cut + PROBE)
        partial = partial + query[cut:upto] @ columns[order[cut:upto]][:, alive]
        cut = upto
        if len(alive) > k:
            floor = partial + np.cumsum(worst[::-1])[::-1][cut] if cut < len(query) else partial
            threshold = max(threshold, np.partition(floor, -k)[-k])
        keep = partial + rest[cut] >= threshold
        alive, partial = alive[keep], partial[keep]
    best = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive][best], partial[best]


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with every row but its own."""
    session(vectors.sparkSession)
    table = materialise(quantised(vectors), "vectors")
    rows = table.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("terms")).alias("width")).first()
    shards, blocks, width = max(1, -(-rows["n"] // SHARD_ROWS)), max(1, -(-rows["q"] // QUERY_BLOCK)), rows["width"] or 0
    place = F.xxhash64("vec_id", "terms")
    shard = F.pmod(place, F.lit(shards)).cast("int").alias("shard")
    candidates = table.select("vec_id", "terms", shard, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = table.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("terms").alias("query_terms"), F.pmod(place, F.lit(blocks)).cast("int").alias("block"))

    def cell(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(shard):
            shard = shard.sort_values("vec_id", kind="stable")
            ids = shard["vec_id"].to_numpy()
            columns = np.ascontiguousarray(matrix(shard["terms"], width).T)
            low, high = columns.min(axis=1, initial=0), columns.max(axis=1, initial=0)
            for query_id, terms, known in zip(queries["query_id"], matrix(queries["query_terms"], width), queries["known"], strict=True):
                found, scores = search_shard(terms, query_id, ids, columns, low, high, k, known)
                out.append((np.full(len(found), query_id), found, scores.astype(np.int64)))
        parts = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pd.DataFrame({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})

    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    done, upto = 0, 1
    while done < shards:
        upto = min(upto, shards)
        if best is None:
            now = asked.withColumn("known", F.lit(float("-inf")))
        else:
            kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("known"))
            now = asked.join(kth, "query_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
        now = now.select("query_id", "query_terms", "block", "known", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))).alias("shard"))
        some = candidates.filter(F.col("shard").between(done, upto - 1))
        found = now.groupBy("shard", "block").cogroup(some.groupBy("shard", "block")).applyInPandas(cell, FOUND)
        found = found if best is None else found.union(best.select("query_id", "vec_id", "score"))
        best = found.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)
        done, upto = upto, upto * GROWTH
        best = materialise(best, "best") if done < shards else best
    return best.select("query_id", "rank", "vec_id", "score")


def pairs_by_definition(ids: list[int], terms: np.ndarray, queries: Iterator[int], k: int) -> list[tuple[int, int, int, int]]:
    """Brute force over all pairs, for tests and recall figures."""
    out = []
    for q in queries:
        scores = [(-int(terms[q] @ terms[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]]
        out += [(ids[q], r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return out
