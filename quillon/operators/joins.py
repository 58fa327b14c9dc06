"""Join shapes: membership, absence, mismatch, version floors, alignment of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_or_over_floor(items: DataFrame, floors: DataFrame, key: str, version: str, floor: str) -> DataFrame:
    """Items whose version is at least their key's floor; a semi-join, so nothing multiplies and nothing needs a distinct."""
    f = floors.select(F.col(key).alias("_key"), F.col(floor).alias("_floor"))
    return items.join(f, (F.col(key) == F.col("_key")) & (F.col(version) >= F.col("_floor")), "left_semi")


def members(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return df.join(allowed, key, "left_semi")


def absent(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known, key, "left_anti")


def mismatches(left: DataFrame, right: DataFrame, key: str, column: str, names: tuple[str, str, str]) -> DataFrame:
    """Keys that are on one side only, or whose values differ; names: only left, only right, differing."""
    a = left.select(key, F.col(column).alias("left_value"), F.lit(True).alias("_a"))
    b = right.select(key, F.col(column).alias("right_value"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_b").isNull(), names[0]).when(F.col("_a").isNull(), names[1]).when(~F.col("left_value").eqNullSafe(F.col("right_value")), names[2])
    return a.join(b, key, "full_outer").select(key, kind.alias("kind"), "left_value", "right_value").filter("kind IS NOT NULL")


def aligned_difference(now: Column, before: Column) -> Column:
    """Arrays of (le, cum) structs: the counts of ``now`` less those of ``before`` with the same le, never below 0."""
    earlier = F.map_from_entries(before)
    return F.transform(now, lambda b: F.struct(b["le"].alias("le"), F.greatest(b["cum"] - F.coalesce(F.try_element_at(earlier, b["le"]), F.lit(0.0)), F.lit(0.0)).alias("cum")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays as sets; 1.0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
