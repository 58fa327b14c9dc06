"""Near copies by SimHash positions: five-word shingles, Jaccard similarity of 0.8 or more.

At similarity 0.8 the fingerprints of two texts may differ in ten bits of 64 and in all their bytes, so a single
fingerprint guarantees no matches. Here a fingerprint has ``POSITIONS`` positions, and each position is a
SimHash of its own class of shingles (by hash). The number of classes grows with the text, so that a class
holds two to four shingles; near a change of that number a text has positions for both. A shingle that two
texts don't share disturbs one position, so texts that differ in at most ``POSITIONS - SHARED`` indexed
shingles agree in at least ``SHARED`` positions.

The inverted index maps a position and its bytes to the texts that have them. Pairs of a list are tallied, those
that may share ``SHARED`` positions (all positions, where a text has fewer; lists too long to be paired count as
shared) are kept, and each is verified by the Jaccard similarity of the whole shingle sets. Each member of a list of more
than ``DENSE`` texts first meets the list's centre only, the text with the most company in all its lists of the same
level. Once components have joined what was found so far, texts of a long list that are still apart are compared,
all with all in blocks: the largest component of the list makes blocks of its own, which don't meet each other, and
a task takes one pair of blocks. In it only pairs that share one of their rarest shingles, as texts of that similarity
must, are counted. So every pair of a long list is verified or connected. Texts enter once, whatever their copies.

Edge cases: null and empty texts are copies of the empty text; texts under five words are one shingle; of equal
rows one stays; null doc_ids lose against known ones; extra columns pass through, whatever their names; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import known_text, materialise, session, text_bytes
from .simhash import components, shingle_hashes

POSITIONS, SHARED, DENSE = 32, 3, 12
#: Members of a long list that meet its centre in one group.
PORTION = 128
#: Shingles of a block of a long list, and what a text counts beside its own.
BLOCK, TEXT = 1 << 20, 512
#: Texts of a side of a tile, pairs of a tile that are compared one by one, and shingles that are counted at once for a tile.
TILE, FEW, COUNTED = 128, 256, 8192
KEYS = "tid binary, n int, positions int, keys array<long>, z binary"


def levels(n: int) -> list[int]:
    """Binary logarithms of the numbers of classes of a text of n shingles."""
    at = [max(5, int(x).bit_length() - 2) for x in (n, n * 1.25)]
    return sorted(set(at))


def position_keys(hashes: np.ndarray) -> tuple[list[int], int]:
    """Index keys (signed) of a set of shingle hashes at all its levels, and the positions of the first level."""
    out: list[np.ndarray] = []
    first = 0
    for level in levels(len(hashes)):
        place = hashes & np.uint64((1 << level) - 1)
        chosen = hashes[place < POSITIONS]
        where = place[place < POSITIONS].astype(np.int64)
        bits = np.unpackbits(chosen.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :4], axis=1).astype(np.int64)
        ones = np.zeros((POSITIONS, 32), np.int64)
        np.add.at(ones, where, bits)
        count = np.bincount(where, minlength=POSITIONS)
        used = np.flatnonzero(count)
        value = np.packbits(2 * ones[used] > count[used][:, None], axis=1).view(">u4").ravel().astype(np.uint64)
        out.append((value << np.uint64(16)) | np.uint64(level << 8) | used.astype(np.uint64))
        first = first or len(used)
    return np.concatenate(out).view(np.int64).tolist() if out else [], first


def shingle_set(text: bytes, size: int) -> np.ndarray:
    found = np.unique(shingle_hashes(text, size))
    return found if len(found) else np.zeros(1, np.uint64)


def indexed(texts: DataFrame, size: int) -> DataFrame:
    """tid, n (shingles), positions, keys, z (the compressed text) of each row of ``texts`` (tid, text)."""
    session(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            tids = batch.column(0).to_pylist()
            new = list(dict(zip(tids, range(len(tids)), strict=True)).values())  # equal texts of a batch once
            texts = text_bytes(batch.column(1))
            sets = [shingle_set(texts[i], size) for i in new]
            keys = [position_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tids[i] for i in new], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[0] for k in keys], pa.list_(pa.int64())), pa.array([pack.compress(texts[i]) for i in new], pa.binary())],
                ["tid", "n", "positions", "keys", "z"],
            )

    return texts.mapInArrow(run, KEYS)


def position_lists(texts: DataFrame) -> DataFrame:
    """A row for each text of each list of two texts or more; texts: tid, n, positions, keys, one row each."""
    index = texts.select("tid", "n", "positions", F.explode("keys").alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    listed = materialise(index.join(sizes, "key"), "positions")
    # what a text's lists say about it: its company at each level (a text has one, or two that follow each other),
    # and how many are too long to be paired
    even = F.col("key").bitwiseAND(F.lit(256)) == 0
    met = F.log2("size")
    company = listed.groupBy("tid").agg(F.sum(F.when(even, met)).alias("even"), F.sum(F.when(~even, met)).alias("odd"), F.count(F.when(F.col("size") > DENSE, 1)).cast("int").alias("crowds"))
    return materialise(listed.join(company, "tid").withColumn("company", F.when(even, F.col("even")).otherwise(F.col("odd"))).drop("even", "odd"), "lists")


def candidates(texts: DataFrame, similarity: float, lists: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of tids that share enough positions; of long lists only pairs with the centre."""
    lists = position_lists(texts) if lists is None else lists
    entry = F.struct("tid", "n", "positions", "crowds")

    def paired(grouped: DataFrame) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        fits = F.filter("entries", lambda e: (e["tid"] > F.col("a.tid")) & (F.least(e["n"], F.col("a.n")) >= similarity * F.greatest(e["n"], F.col("a.n"))))
        both = grouped.select(F.explode("entries").alias("a"), "entries").select("a", F.explode(fits).alias("b"))
        return both.select(a["tid"].alias("a"), b["tid"].alias("b"), (F.least(F.lit(SHARED), a["positions"], b["positions"]) - F.least(a["crowds"], b["crowds"])).alias("least"))

    small = paired(lists.filter(F.col("size") <= DENSE).groupBy("key").agg(F.collect_list(entry).alias("entries")))
    tallied = small.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("least").alias("least"))
    large = lists.filter(F.col("size") > DENSE)
    # a long list meets its centre in portions, so that none has a task of its own
    portions = F.ceil(F.col("size") / PORTION).cast("int")
    centres = large.groupBy("key").agg(F.max_by(entry, F.struct("company", "tid")).alias("centre"), F.max("size").alias("size"))
    centres = centres.select("key", "centre", F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"))
    dealt = large.withColumn("portion", F.pmod(F.xxhash64("tid"), portions).cast("int"))
    starred = dealt.join(centres, ["key", "portion"]).filter((F.col("tid") != F.col("centre.tid")) & (F.least("n", "centre.n") >= similarity * F.greatest("n", "centre.n")))
    starred = starred.select(F.least("tid", "centre.tid").alias("a"), F.greatest("tid", "centre.tid").alias("b"))
    return tallied.filter("shared >= least").select("a", "b").union(starred).distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for z_a, z_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if z_a != last[0]:
                    last = (z_a, shingle_set(unpack.decompress(z_a), size))
                other = shingle_set(unpack.decompress(z_b), size)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(both >= similarity * (len(last[1]) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    z = texts.select("tid", "z")
    with_b = pairs.join(z.select(F.col("tid").alias("b"), F.col("z").alias("z_b")), "b")
    both = with_b.join(z.select(F.col("tid").alias("a"), F.col("z").alias("z_a")), "a").select("a", "b", "z_a", "z_b")
    return both.mapInArrow(run, "a binary, b binary")


def shared_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all sets of ``b``."""
    flat = [np.concatenate(x) for x in (a, b)]
    owner = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b)]
    both = np.intersect1d(*flat)
    found = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(both), COUNTED):
        some = both[start : start + COUNTED]
        has = []
        for x, o, sets in zip(flat, owner, (a, b), strict=True):
            at = np.minimum(np.searchsorted(some, x), len(some) - 1)
            hit = some[at] == x
            has.append(np.zeros((len(sets), len(some)), np.float32))
            has[-1][o[hit], at[hit]] = 1
        found += has[0] @ has[1].T
    return found


def sharing_prefixes(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Symmetric matrix of the pairs of sets that may have the similarity, as their rarest shingles have one in common.

    Sets of that similarity share at least similarity * n shingles of either, so the n - that + 1 rarest of both meet.
    """
    sizes = np.array([len(x) for x in sets])
    place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    what, who = rank[place], np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((what, who))
    nth = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = order[nth < np.repeat(sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, sizes)]
    order = order[np.argsort(what[order], kind="stable")]
    what, who = what[order], who[order]
    starts = np.flatnonzero(np.r_[True, what[1:] != what[:-1]])
    ends = np.r_[starts[1:], len(what)]
    found = np.zeros((len(sets), len(sets)), bool)
    met: set[bytes] = set()
    for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        together = who[start:end]
        if (name := together.tobytes()) not in met:  # a passage gives the same texts many times
            met.add(name)
            found[np.ix_(together, together)] = True
    return found


def similar(sets: list[np.ndarray], may: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """The pairs (i, j) of ``may`` whose sets have the similarity; tiles with many pairs are counted as matrix products."""
    n = np.array([len(x) for x in sets])
    for i in range(0, len(sets), TILE):
        for j in range(0, len(sets), TILE):
            tile = may[i : i + TILE, j : j + TILE]
            pairs = np.argwhere(tile) + [i, j]
            if len(pairs) > FEW:
                a, b = np.flatnonzero(tile.any(axis=1)) + i, np.flatnonzero(tile.any(axis=0)) + j
                both = np.zeros(tile.shape, np.float32)
                both[np.ix_(a - i, b - j)] = shared_shingles([sets[x] for x in a.tolist()], [sets[x] for x in b.tolist()])
                shared = both[tile]
            else:
                shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs.tolist()])
            if len(pairs):
                yield from map(tuple, pairs[shared >= similarity * (n[pairs].sum(axis=1) - shared) - 1e-9].tolist())


def left_apart(large: DataFrame, roots: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between the roots of texts that share a long list, have the similarity and are not connected.

    large: key, tid, n, size of the list; roots: node, root.
    """
    session(texts.sparkSession)
    root = F.coalesce("root", "tid")
    members = materialise(large.select("key", "tid", "n", "size").join(roots, F.col("tid") == F.col("node"), "left").select("key", "tid", root.alias("root"), "n", "size"), "members")
    weight = F.sum(F.col("n") + F.lit(TEXT).cast("long"))
    parts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), weight.alias("weight"), F.bit_xor(F.xxhash64("tid")).alias("texts"))
    lists = parts.groupBy("key").agg(F.max_by("root", F.struct("weight", "root")).alias("main"), F.max("weight").alias("most"), F.sum("weight").alias("weight"), F.sum("n").alias("size"), F.bit_xor("texts").alias("texts"))
    # lists of the same texts count once
    lists = lists.filter("weight > most").groupBy("texts", "size").agg(F.min_by(F.struct("key", "main", "most", "weight"), "key").alias("l"))
    mains, rest = F.ceil(F.col("l.most") / BLOCK).cast("int"), F.ceil((F.col("l.weight") - F.col("l.most")) / BLOCK).cast("int")
    portions = F.ceil(F.col("size") / PORTION).cast("int")
    lists = lists.select("l.key", "l.main", mains.alias("mains"), rest.alias("rest"), F.explode(F.sequence(F.lit(0), portions - 1)).alias("portion"))
    dealt = members.withColumn("portion", F.pmod(F.xxhash64("tid"), portions).cast("int")).drop("n", "size").join(lists, ["key", "portion"])
    place, inside = F.xxhash64("tid", "key"), F.col("root") == F.col("main")
    own = F.when(inside, F.col("rest") + F.pmod(place, "mains")).otherwise(F.pmod(place, "rest")).cast("int")
    last = F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    placed = dealt.select("key", "tid", "root", own.alias("own"), last.alias("last")).join(texts.select("tid", "z"), "tid")
    facing = placed.select("key", "root", "z", "own", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    facing = facing.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "root", "z")

    def run(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        own, name = group.column("own").to_numpy(), group.column("root").to_pylist()
        kind = np.unique(np.array([x.hex() for x in name]), return_inverse=True)[1]
        may = (own == low)[:, None] & (own == high) & (kind[:, None] != kind)
        links: set[tuple[bytes, bytes]] = set()
        if may.any():
            unpack = zstandard.ZstdDecompressor()
            sets = [shingle_set(unpack.decompress(z.as_py()), size) for z in group.column("z")]
            may &= sharing_prefixes(sets, similarity)
            n = np.array([len(x) for x in sets])
            may &= np.minimum(n[:, None], n) >= similarity * np.maximum(n[:, None], n)
            if low == high:
                may = np.triu(may)
            links = {(name[i], name[j]) for i, j in similar(sets, may, similarity)}
        return pa.table([pa.array([x for x, _ in links], pa.binary()), pa.array([x for _, x in links], pa.binary())], names=["a", "b"])

    return facing.groupBy("key", "low", "high").applyInArrow(run, "a binary, b binary")


def groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """tid (MD5 of the text), root (of its group), low (smallest doc_id of the text), one row per distinct text."""
    tid = F.unhex(F.md5(known_text().cast("binary")))
    named = docs.select(tid.alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    lows = named.groupBy("tid").agg(F.min("doc_id").alias("low"))
    found = indexed(named.select("tid", "text"), size).groupBy("tid").agg(*(F.first(c).alias(c) for c in ("n", "positions", "keys", "z")))
    texts = materialise(found, "texts")
    lists = position_lists(texts)
    pairs = materialise(candidates(texts, similarity, lists), "pairs")
    roots = components(verified(pairs, texts, size, similarity))
    more = materialise(left_apart(lists.filter(F.col("size") > DENSE), roots, texts, size, similarity), "links")
    if not more.isEmpty():
        upper = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = lows.select(F.col("tid").alias("node")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        roots = known.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return lows.join(roots, lows.tid == roots.node, "left").select("tid", F.coalesce("root", "tid").alias("root"), "low")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, without all but one of each group of near copies: the one with the smallest doc_id stays."""
    found = groups(docs, size, similarity)
    first = F.min_by(F.struct("tid", "low"), F.struct(F.col("low").isNull(), "low", "tid"))
    keepers = found.groupBy("root").agg(first.alias("k")).select(F.col("k.tid").alias("keep_tid"), F.col("k.low").alias("keep_doc"))
    plain = docs.toDF(*(f"c_{i}" for i in range(len(docs.columns))))
    place = {name: f"c_{i}" for i, name in enumerate(docs.columns)}
    rows = plain.withColumn("tid", F.unhex(F.md5(known_text(place["text"]).cast("binary")))).withColumn("doc", F.col(place["doc_id"]).cast("long"))
    single = rows.dropDuplicates(["tid", "doc"])
    kept = single.join(keepers, (F.col("tid") == F.col("keep_tid")) & F.col("doc").eqNullSafe(F.col("keep_doc")), "left_semi")
    return kept.select(*(F.col(f"c_{i}").alias(name) for i, name in enumerate(docs.columns)))


def similar_pairs(texts: list[str], size: int, similarity: float) -> pd.DataFrame:
    """Brute force over all pairs of texts, for tests."""
    sets = [set(shingle_set(t.encode(), size).tolist()) for t in texts]
    out = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return pd.DataFrame(out, columns=["i", "j"])
