"""SimHash near-duplicates: positional-byte index, count filter, verification, connected components.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most ``k`` bits differ in at
most ``k`` bytes, so at least ``8 - k`` positional bytes agree. Lists of single bytes would pair every
fingerprint with a fixed share of all others, so a list is kept for four positions and the bytes there. The fours
are the blocks of a Steiner system S(3, 4, 8): of its 14 blocks, 14 lie in all eight positions, 7 in any seven, 3 in
any six, 1 in any five and at most 1 in any four. So the number of lists in which a pair meets tells how many
positional bytes agree: list hits are tallied by pair, pairs with fewer hits than ``8 - k`` agreeing bytes guarantee
(3 for k = 2) are dropped, and the rest are verified by their differing bits.

Only distinct fingerprints enter, each with its smallest doc_id, so copies never meet as pairs. A list of
more than ``DENSE`` fingerprints is not paired: its members are linked exactly through shared neighbours
at one flipped bit (for k = 2 two fingerprints are linked if and only if they share one), each to the
smallest fingerprint there, which costs 65 rows a fingerprint however long the list is. A pair that shares such a
list is linked there, and a pair that shares none has all its hits tallied.

Edge cases: null and empty texts have fingerprint zero; null doc_ids are kept and sort last among the
members of a component; bits set in exactly half of the shingles are 0; very long texts are hashed whole, in portions;
repeated rows give repeated rows; columns other than doc_id and text are not used, so clashing names do no harm; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, session, spread_join, text_bytes

SEED = 42
#: Fingerprints in an index list that are still paired; longer lists take the exact other way.
DENSE = 48
#: The blocks of S(3, 4, 8): planes of the three-dimensional space over two elements, so fours of positions whose exclusive or is 0.
BLOCKS = [(a, b, c, a ^ b ^ c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8) if a ^ b ^ c > c]
#: Lists that a pair meets in at least, by differing bytes.
HITS = (14, 7, 3)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, size)) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at ``bits`` (2 at most) or fewer differing bits."""
    if bits > 2:
        raise ValueError("the index guarantees up to two differing bits")
    fp = F.col("fp")
    keys = []
    for i, block in enumerate(BLOCKS):
        mask = sum(0xFF << (56 - 8 * p) for p in block)
        keys.append(F.struct(F.lit(i).alias("list"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes")))
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = materialise(index.join(sizes, "key"), "lists")
    small = listed.filter(F.col("n") <= DENSE).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b"))
    tallied = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= HITS[bits])
    close = tallied.filter(F.expr(f"bit_count(a ^ b) <= {bits}")).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    crowded = listed.filter(F.col("n") > DENSE).select("fp").distinct()
    near = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("near"))
    hubs = near.groupBy("near").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    starred = near.join(hubs, "near").filter("fp > low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()
    if bits < 2:
        starred = starred.filter(F.expr(f"bit_count(a ^ b) <= {bits}"))
    return close.union(starred)


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """node and root (the smallest node reachable) for the nodes of undirected ``edges`` (a, b), any orderable type.

    Large-star and small-star steps in turn; each is one grouping of the edges, and they take a number
    of rounds logarithmic in the longest path. Every round is written to the shared folder; the edges of a node with
    many (a giant component's root) are spread over tasks.
    """
    edges = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(limit):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both, low, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, down, "a", "b").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small = materialise(small, "edges")
        sums = [e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for e in (edges, small)]
        edges = small
        if sums[0] == sums[1]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle within {limit} rounds")


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable)."""
    found = materialise(fingerprints(docs, size), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), bits))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = member.join(named, "root").select("fp", "component_id")
    return spread_join(found, labels, "fp", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
