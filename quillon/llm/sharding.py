"""Resharding by minimum-cost flow: new shard capacities are met while the fewest bytes move.

Old shards supply bytes and new shards take them up to their capacity; staying costs nothing, a byte moved
costs one. The flow is solved on the driver over shards alone (their number is fixed, not that of rows).
Each old shard is an ordered run of blocks, largest rows first, and a flow is a contiguous piece of that
run, so a piece's end is off by less than one of the smallest rows there. Places in a run come from sums
over blocks (old shard, size class, salt) and one window within each block, never over a whole shard.

A rewrite works on a narrow table of rows, known by their file and place in it, until every row has its shard and slot;
texts then move once, by file and place. Copies of a key are numbered within salts, so that a key that a third of
all rows have is no task's alone, and the numbering follows from the files, so a task that runs again numbers alike.

Edge cases: a null text has size 1; very long texts are a block like others, and a piece's end is off by up to one of
them; rows that tie in size go by doc_id and checksum; rows that repeat wholly are counted first and dealt one by one
at the end, in portions; null doc_ids are ordinary keys; an empty table gives an empty result; extra columns pass
through rewrite(), and placed() uses doc_id and text alone, so clashing names do no harm.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, known_text, materialise

#: Fixed value: salts of a size class, so that a class that holds a third of all rows is many blocks.
SALTS = 64
#: Copies of a row that are dealt in one go.
PORTION = 4096


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Units from each supplier to each taker at the least total cost; successive shortest paths.

    Supplies must not exceed capacities in total. Every path is found with reduced costs, so the flow is
    optimal after each of them.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold all")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        dist = {i: 0 - potential[i] for i in range(n) if left[i]}
        base = min(dist.values())
        dist = {i: d - base for i, d in dist.items()}
        came: dict[int, int] = {}
        heap = [(d, i) for i, d in dist.items()]
        heapq.heapify(heap)
        done: set[int] = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in steps:
                new = d + c + potential[u] - potential[v]
                if v not in done and new < dist.get(v, 1 << 200):
                    dist[v] = new
                    came[v] = u
                    heapq.heappush(heap, (new, v))
        sink = min((j for j in range(m) if room[j] and n + j in dist), key=lambda j: (dist[n + j] + potential[n + j], j))
        path = [n + sink]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        units = min(left[path[0]], room[sink])
        for u, v in zip(path, path[1:], strict=False):
            if u >= n:
                units = min(units, flow[v][u - n])
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += units
            else:
                flow[v][u - n] -= units
        left[path[0]] -= units
        room[sink] -= units
        far = max(dist.values())
        potential = [p + dist.get(i, far) for i, p in enumerate(potential)]
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def transfers(old_bytes: Sequence[int], capacities: Sequence[int]) -> list[list[int]]:
    """The flow that moves the fewest bytes; shard i of the old layout is shard i of the new one."""
    cost = [[0 if i == j else 1 for j in range(len(capacities))] for i in range(len(old_bytes))]
    return min_cost_flow(old_bytes, capacities, cost)


def placed(docs: DataFrame, capacities: Sequence[int] | int, old: F.Column | None = None, old_shards: int = 12) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, copy (number among equal ones): one row per input row.

    capacities: bytes that each new shard holds, or a number of shards of even sizes. old: the shard (int)
    that a row is in now; without it the layout is taken to be ``old_shards`` shards by hash.
    """
    size = (F.octet_length(known_text()) + 1).cast("long")
    crc = F.crc32(known_text().cast("binary"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *([] if old is None else [old.cast("int").alias("old_shard")]))
    if old is None:
        narrow = narrow.withColumn("old_shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(old_shards)).cast("int"))
    return dealt_out(narrow, capacities, old_shards if old is None else 0)


def dealt_out(narrow: DataFrame, capacities: Sequence[int] | int, old_shards: int = 0) -> DataFrame:
    """placed() for rows of doc_id, size, text_crc32 and old_shard; old_shards: how many there are at least."""
    spark = narrow.sparkSession
    rows = narrow.groupBy("old_shard", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"class": F.floor(F.log2("size") * 4).cast("int"), "salt": F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(SALTS)).cast("int")})
    block = ["old_shard", "class", "salt"]
    inside = Window.partitionBy(*block).orderBy(F.desc("size"), "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = materialise(rows.withColumns({"at": F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)), "rank": F.coalesce(F.sum("n").over(inside), F.lit(0))}), "shard-rows")
    blocks = rows.groupBy(*block).agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows"))
    before = Window.partitionBy("old_shard").orderBy(F.desc("class"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(*block, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_at"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rank"))
    totals = {r["old_shard"]: r["bytes"] for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    known = [totals.get(i, 0) for i in range(max([old_shards - 1, *totals]) + 1)] if totals else [0] * old_shards
    if isinstance(capacities, int):
        capacities = even_capacities(sum(known), capacities)
    flow = transfers(known, capacities)
    cuts = []
    for i, row in enumerate(flow):
        at, ends, targets = 0, [], []
        for j in sorted((j for j in range(len(row)) if row[j]), key=lambda j: (j != i, j)):
            at += row[j]
            ends.append(at)
            targets.append(j)
        cuts.append((i, ends[:-1], targets or [0]))
    plan = spark.createDataFrame(cuts, "old_shard int, ends array<bigint>, targets array<int>")
    dealt = rows.join(bases, block).join(F.broadcast(plan), "old_shard").select("doc_id", "size", "text_crc32", "old_shard", "ends", "targets", "at", "base_at", "rank", "base_rank", "n")
    dealt = dealt.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PORTION).cast("long"))))
    many = dealt.filter(F.col("n") > PORTION).repartition("doc_id", "text_crc32", "from")
    copies = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PORTION, "n") - 1))
    dealt = dealt.filter(F.col("n") <= PORTION).union(many).withColumn("k", copies).drop("from", "n")
    middle = F.col("base_at") + F.col("at") + F.col("k") * F.col("size") + F.expr("size div 2")
    dealt = dealt.withColumns({"middle": middle, "place": F.col("base_rank") + F.col("rank") + F.col("k")})
    dealt = dealt.withColumn("piece", F.size(F.filter("ends", lambda e: e <= F.col("middle"))))
    dealt = dealt.withColumn("shard", F.element_at("targets", F.col("piece") + 1)).drop("ends", "targets", "middle", "at", "base_at", "rank", "base_rank")
    dealt = materialise(dealt, "shard-places")
    pieces = dealt.groupBy("old_shard", "piece", "shard").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    filled = [0] * len(capacities)
    starts = []
    for p in sorted(pieces, key=lambda p: (p["shard"], p["old_shard"] != p["shard"], p["old_shard"])):
        starts.append((p["old_shard"], p["piece"], filled[p["shard"]] - p["first"]))
        filled[p["shard"]] += p["n"]
    shift = spark.createDataFrame(starts, "old_shard int, piece int, shift bigint")
    return dealt.join(F.broadcast(shift), ["old_shard", "piece"]).select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("place") + F.col("shift")).alias("slot"), F.col("k").alias("copy"))


KEY = ["doc_id", "size", "text_crc32", "old_shard"]
#: What tells a row of a shard's Parquet files from all others, the same each time it is read.
FILE = ("_metadata.file_name", "file"), ("_metadata.row_index", "line")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left's columns and those of right that aren't keys; a null key equals a null key."""
    theirs = right.select(*(F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns))
    return left.join(theirs, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in keys]).drop(*(f"r_{c}" for c in keys))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (KEY, file, line) with ``copy``, the number of each row among those of its key, from 0."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("file", "line"), F.lit(SALTS)).cast("int"))
    before = Window.partitionBy(*KEY).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy(*KEY, "salt").agg(F.count(F.lit(1)).alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    joined = null_safe_join(salted, bases, [*KEY, "salt"])
    inside = Window.partitionBy(*KEY, "salt").orderBy("file", "line")
    return joined.withColumn("copy", F.col("base") + F.row_number().over(inside) - 1).drop("salt", "base")


def rewrite(spark, old_dir: str, new_dir: str, new_shards: int, slot: str | None = None) -> list[tuple[int, str]]:
    """Reshard a table kept as ``old_dir``/shard=K/: rewrite only the shards that give or take rows.

    slot: a name for a column of the rewritten rows that keeps their slots; all shards are then rewritten.
    Returns (shard, folder) for every new shard; a folder under ``old_dir`` is a shard left as it was.
    """
    old = spark.read.parquet(old_dir)
    size, crc = (F.octet_length(known_text()) + 1).cast("long"), F.crc32(known_text().cast("binary"))
    narrow = materialise(old.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.col("shard").cast("int").alias("old_shard"), *(F.col(c).alias(n) for c, n in FILE)), "narrow")
    places = materialise(dealt_out(narrow, new_shards, old_shards=0), "places")
    changed = places.filter(F.lit(slot is not None) | (F.col("old_shard") != F.col("shard"))).select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    touched = sorted(r["shard"] for r in changed.collect())
    rows = numbered(narrow)
    to = null_safe_join(rows, places, [*KEY, "copy"]).select("old_shard", "file", "line", F.col("shard").alias("to_shard"), F.col("slot").alias("to_slot")).filter(F.col("to_shard").isin(touched))
    to = materialise(to, "moves")
    own = [F.col(c).alias(f"own_{c}") for c in old.columns if c != "shard"]
    moved = old.select(*own, F.col("shard").cast("int").alias("old_shard"), *(F.col(c).alias(n) for c, n in FILE)).join(to.hint("merge"), ["old_shard", "file", "line"])
    moved = moved.select(*(F.col(f"own_{c}").alias(c) for c in old.columns if c != "shard"), F.col("to_shard").alias("shard"), *([] if slot is None else [F.col("to_slot").alias(slot)]))
    moved.write.option("compression", "zstd").partitionBy("shard").parquet(new_dir)
    there = {r["shard"] for r in places.select("shard").distinct().collect()}
    return [(s, f"{new_dir if s in touched else old_dir}/shard={s}") for s in sorted(there)]


def resharded(docs: DataFrame, new_shards: int, old_shards: int = 12) -> DataFrame:
    """The rows of placed(), made from shards: the documents are laid out in ``old_shards`` shards by hash, these are
    rewritten into ``new_shards`` in the shared folder, and what is in the new shards is read back."""
    spark = docs.sparkSession
    if docs.isEmpty():
        return placed(docs, new_shards, old_shards=old_shards)
    crc, size = F.crc32(known_text().cast("binary")), (F.octet_length(known_text()) + 1).cast("long")
    old = F.pmod(F.xxhash64("doc_id", crc), F.lit(old_shards)).cast("int")
    rest = [F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    laid = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest).withColumn("shard", old)
    old_dir, new_dir = fresh_path(spark, "old-shards"), fresh_path(spark, "new-shards")
    laid.write.option("compression", "zstd").partitionBy("shard").parquet(old_dir)
    made = rewrite(spark, old_dir, new_dir, new_shards, slot="slot")
    back = spark.read.option("basePath", new_dir).parquet(*(folder for _, folder in made))
    return back.select("doc_id", size.alias("size"), crc.alias("text_crc32"), old.alias("old_shard"), F.col("shard").cast("int").alias("shard"), "slot")
