"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source token shares are raised to an exponent between 0 and 1 and normalised. The exponent is bisected to within
2**-40: as it grows, the weights' entropy falls, and so does the repetition of small sources. Taken is the smallest
exponent, so the flattest mix, at which the target entropy is met or no source goes beyond the repetition limit.
A source's quota is its weight times the token budget. Whole passes give every document once each; the
remaining tokens are taken by whole blocks in the order of a permutation (by hash of source, block, pass), the
block in which the quota ends by its parts in the same way, and the part in which it ends is cut between two
documents.

Only DataFrame functions are used. Sums go over the parts of blocks, of which every source has up to 16,384, so a
source with a third of all rows has no task of its own. The plan of a block is broadcast while it has at most
``BROADCAST_ROWS`` rows and joined through a shuffle beyond, where no key has more than a block. Texts are read
twice: to count tokens, and to deal. Only the documents of cut parts are sorted, equal ones as one row with a count,
so rows that repeat have no task of their own either.

Edge cases: a null source is a source of its own; null and empty texts have no tokens, count one so that they
keep a place, and are dealt like others; very long texts count whole, and one that doesn't fit into what is left of a
quota ends it; ties in a permutation go by block, part and doc_id; an empty table gives an empty result; rows that
repeat are dealt each; extra columns pass through mixed(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import known_text, materialise

BLOCKS, PARTS = 256, 64
#: Rows of a plan (sources times blocks, or times parts) that are broadcast, some 40 bytes each; larger plans are joined.
BROADCAST_ROWS = 131_072
WORDS = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(known_text(text), F.lit(WORDS))).cast("long")


def weights_at(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent for s in shares]
    return [r / sum(raised) for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w)


def temperature(totals: list[int], budget: int, *, target_entropy: float | None = None, repetition: float | None = None) -> tuple[float, list[float]]:
    """The exponent and weights: at the target entropy, or the flattest mix (smallest exponent) within the repetition limit."""
    shares = [t / sum(totals) for t in totals]

    def flat_enough(exponent: float) -> bool:
        weights = weights_at(shares, exponent)
        if target_entropy is not None:
            return entropy(weights) <= target_entropy
        return max(w * budget / t for w, t in zip(weights, totals, strict=True)) <= repetition

    low, high = 0.0, 1.0
    if flat_enough(0.0):
        high = 0.0
    else:
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high, weights_at(shares, high)


def whole_corpus(totals: list[int], repetition: float) -> tuple[float, list[float], int]:
    """Exponent, weights and the least budget at which every source is dealt whole once, and none over ``repetition`` times."""
    shares = [t / sum(totals) for t in totals]
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        rates = [w / s for w, s in zip(weights_at(shares, middle), shares, strict=True)]
        low, high = (low, middle) if max(rates) / min(rates) <= repetition else (middle, high)
    weights = weights_at(shares, high)
    return high, weights, math.ceil(max(t / w for t, w in zip(totals, weights, strict=True)))


def plan(counts: list[tuple[str | None, int]], budget: int | None, target_entropy: float | None, repetition: float) -> list[tuple[str | None, int, int, int]]:
    """(source, passes, tokens beyond them, quota) of every source."""
    if not counts:
        return []
    totals = [c for _, c in counts]
    floors = totals if budget is None else [0] * len(totals)
    if budget is None:
        _, weights, budget = whole_corpus(totals, repetition)
    else:
        _, weights = temperature(totals, budget, target_entropy=target_entropy, repetition=None if target_entropy is not None else repetition)
    quotas = [max(int(w * budget), least) for w, least in zip(weights, floors, strict=True)]
    return [(s, q // t, q % t, q) for (s, t), q in zip(counts, quotas, strict=True)]


def dealt(docs: DataFrame, *, budget: int | None = None, target_entropy: float | None = None, repetition: float = 1.5, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` under one struct ``row``, with mix_source, mix_block, mix_pass and mix_place.

    budget: tokens in all; None: as many as deal every source whole once. One row for each time a document
    is dealt. mix_place orders the blocks of a pass. Reaches the driver: a row per source.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    hashed = F.xxhash64("row.doc_id", "row.text", F.lit(seed))
    block, part = F.pmod(hashed, F.lit(BLOCKS)), F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(PARTS))
    rows = rows.select("row", F.col("row.source").cast("string").alias("mix_source"), block.cast("int").alias("mix_block"), part.cast("int").alias("mix_part"))
    parts = materialise(rows.groupBy("mix_source", "mix_block", "mix_part").agg(F.sum(tokens("row.text")).alias("tokens")), "source-parts")
    blocks = parts.groupBy("mix_source", "mix_block").agg(F.sum("tokens").alias("tokens"))
    counts = blocks.groupBy("mix_source").agg(F.sum("tokens").alias("tokens"))
    known = sorted(((r["mix_source"], r["tokens"]) for r in counts.collect()), key=lambda r: (r[0] is not None, r[0] or ""))
    made = spark.createDataFrame(plan(known, budget, target_entropy, repetition), "source string, passes long, beyond long, quota long")
    small = lambda df, each: F.broadcast(df) if len(known) * each <= BROADCAST_ROWS else df
    before = lambda keys, order: F.coalesce(F.sum("tokens").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # room: tokens of the quota that are left when a block's turn comes in the last, partial pass
    by_block = blocks.join(small(made, 1), F.col("mix_source").eqNullSafe(F.col("source")))
    room = F.col("beyond") - before(["mix_source"], [F.xxhash64("mix_source", "mix_block", "passes", F.lit(seed)), "mix_block"])
    by_block = by_block.select(F.col("mix_source").alias("s"), F.col("mix_block").alias("b"), "passes", room.alias("room"), F.col("tokens").alias("block_tokens"))
    taken = F.col("room") >= F.col("block_tokens")
    # the block in which the quota ends is dealt by parts, and the part in which it ends by documents
    ending = by_block.filter(~taken & (F.col("room") > 0)).select("s", "b", "room")
    by_part = parts.join(small(ending, 1), F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_block") == F.col("b")))
    part_room = F.col("room") - before(["s", "b"], [F.xxhash64("s", "b", "mix_part", F.lit(seed)), "mix_part"])
    by_part = by_part.select(F.col("s").alias("s2"), F.col("b").alias("b2"), F.col("mix_part").alias("p"), part_room.alias("part_room"), F.col("tokens").alias("part_tokens")).filter("part_room > 0")
    cuts = by_part.filter("part_room < part_tokens").select("s2", "b2", "p", "part_room")
    in_block = F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_block") == F.col("b"))
    in_part = F.col("mix_source").eqNullSafe(F.col("s2")) & (F.col("mix_block") == F.col("b2")) & (F.col("mix_part") == F.col("p"))
    columns = ["row", "mix_source", "mix_block", "mix_pass"]
    # whole blocks and whole parts, in one pass over the rows
    joined = rows.join(small(by_block, BLOCKS), in_block).join(small(by_part.filter("part_room >= part_tokens").select("s2", "b2", "p"), PARTS), in_part, "left")
    last = F.col("passes") - 1 + (taken | F.col("p").isNotNull()).cast("long")
    whole = joined.filter(last >= 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(*columns)
    # cut parts: a row for each of equal rows' first copy, and how many copies fit
    ended = rows.join(small(cuts, 1), in_part).join(small(made.select(F.col("source").alias("s"), "passes"), 1), F.col("mix_source").eqNullSafe(F.col("s")))
    held = ended.withColumn("mix_tokens", tokens("row.text")).groupBy("row", "mix_source", "mix_block", "mix_part", "passes", "part_room", "mix_tokens").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("mix_source", "mix_block", "mix_part").orderBy(F.xxhash64("row.doc_id", "passes"), "row.doc_id", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("part_room") - F.coalesce(F.sum(F.col("n") * F.col("mix_tokens")).over(inside), F.lit(0))
    copies = F.least("n", F.floor(left / F.col("mix_tokens")))
    cut = held.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    dealt_rows = whole.union(cut.withColumn("mix_pass", F.col("passes")).select(*columns))
    return dealt_rows.withColumn("mix_place", F.xxhash64("mix_source", "mix_block", "mix_pass", F.lit(seed)))


def schedule(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens, pass_no, block, block_place: one row for each time a document is dealt."""
    return dealt(docs, **options).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("mix_source").alias("source"), tokens("row.text").alias("n_tokens"), F.col("mix_pass").alias("pass_no"), F.col("mix_block").alias("block"), F.col("mix_place").alias("block_place")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as they are dealt, with their own columns."""
    return dealt(docs, **options).select("row.*")
