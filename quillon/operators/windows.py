"""Per-key order: rates from counters, the latest row, running sums, newest per period, middle rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.clock import micros


def counter_rate(df: DataFrame, key: str, at: str, counter: str, name: str = "rate") -> DataFrame:
    """Adds the rate per second since the key's row before. A counter that fell was reset: all of it counts.

    The first row of a key has no rate. Windows are a millisecond at least.
    """
    own = Window.partitionBy(key).orderBy(at)
    before, seconds = F.lag(counter).over(own), F.greatest((micros(F.col(at)) - micros(F.lag(at).over(own))) / 1e6, F.lit(0.001))
    grown = F.when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before)
    return df.withColumn(name, grown / seconds)


def latest(df: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """The latest row of each key, ties by the last in ``tie``: one partial aggregation, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(at, *tie)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def confirmed(df: DataFrame, key: str, place: str, at: str, rate: str, threshold: float, windows: int, tie: list[str]) -> DataFrame:
    """Keys over the threshold in at least ``windows`` distinct windows at the place where they were last."""
    now = latest(df, [key], at, tie).select(key, F.col(place).alias("_place"))
    there = df.join(now, key).filter((F.col(place) == F.col("_place")) & (F.col(rate) >= threshold))
    return there.groupBy(key).agg(F.count_distinct(at).alias("windows")).filter(F.col("windows") >= windows)


def running_sum(value: str, order: list[str], keys: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the order given."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def middle_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row at zero-based place (n - 1) div 2 of each group."""
    own = Window.partitionBy(*keys)
    ranked = df.withColumns({"_rn": F.row_number().over(own.orderBy(*order)), "_n": F.count(F.lit(1)).over(own)})
    return ranked.filter(F.expr("_rn = (_n - 1) div 2 + 1")).drop("_rn", "_n")


def growth_over_gaps(ticks: DataFrame, key: str, at: str, counter: str) -> DataFrame:
    """Adds ``grown`` to the ticks that have a counter: a failed tick (NULL) drops out and keeps the baseline, so the next one spans it."""
    good = ticks.filter(F.col(counter).isNotNull())
    before = F.lag(counter).over(Window.partitionBy(key).orderBy(at))
    return good.withColumn("grown", F.when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before))
