"""Fixed-bucket histograms that merge by addition, and percentiles over them or over raw values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower edges of the rate buckets and of the latency buckets (microseconds); the last is open.
RATE_EDGES = [0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 20000.0, 50000.0]


def _array(edges: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(e)) for e in edges))


def bucket(value: Column, edges: Sequence[float] = RATE_EDGES) -> Column:
    """Index of the last edge at or below the value, 0 below all of them; a chain of comparisons, without arrays."""
    place = F.lit(0)
    for i, edge in list(enumerate(edges))[1:]:
        place = F.when(value >= F.lit(float(edge)), F.lit(i)).otherwise(place)
    return place


def histogram(value: Column, edges: Sequence[float] = RATE_EDGES) -> Column:
    """Aggregate: the array of counts by bucket. Every count is a partial sum, so it combines before the shuffle."""
    place = bucket(value, edges)
    return F.array(*(F.count(F.when(value.isNotNull() & (place == i), 1)) for i in range(len(edges))))


def merged(vector: Column, width: int = len(RATE_EDGES)) -> Column:
    """Aggregate: element-wise sum of count vectors; vectors of another width drop out."""
    fits = F.size(vector) == width
    return F.array(*(F.coalesce(F.sum(F.when(fits, F.get(vector, F.lit(i)))), F.lit(0)) for i in range(width)))


def percentile(counts: Column, p: float, edges: Sequence[float] = RATE_EDGES) -> Column:
    """The p-th percentile (0..100) of a count vector, linear within the bucket it falls into; 0.0 if empty."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, c: s + c)
    target = total * F.lit(p / 100)
    lows = _array(edges)
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("found"))

    def step(state: Column, count: Column) -> Column:
        seen = state["seen"] + count
        low, high = F.get(lows, state["i"]), F.get(lows, state["i"] + 1)
        here = F.when(high.isNull(), low).otherwise(low + (target - state["seen"]) / count * (high - low))
        found = F.coalesce(state["found"], F.when((count > 0) & (seen >= target), here))
        return F.struct(seen.alias("seen"), (state["i"] + 1).alias("i"), found.alias("found"))

    return F.when(total == 0, F.lit(0.0)).otherwise(F.coalesce(F.aggregate(counts, start, step)["found"], F.lit(0.0)))


def percentile_cumulative(buckets: Column, p: float) -> Column:
    """The p-th percentile of an array of (le, cum) structs in ascending order; an infinite le gives the last finite one."""
    total = F.element_at(buckets, -1)["cum"]
    target = total * F.lit(p / 100)
    start = F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("found"))

    def step(state: Column, b: Column) -> Column:
        le, cum = b["le"].cast("double"), b["cum"].cast("double")
        open_end = le == F.lit(float("inf"))
        inside = state["le"] + (target - state["cum"]) / (cum - state["cum"]) * (le - state["le"])
        here = F.when(open_end, state["le"]).when(cum == state["cum"], le).otherwise(inside)
        found = F.coalesce(state["found"], F.when(cum >= target, here))
        return F.struct(F.when(open_end, state["le"]).otherwise(le).alias("le"), cum.alias("cum"), found.alias("found"))

    return F.when((F.size(buckets) <= 0) | (total <= 0), F.lit(0.0)).otherwise(F.aggregate(buckets, start, step)["found"])


def exact_percentile(value: str, p: float) -> Column:
    """Aggregate: interpolated at rank p (n - 1); 0.0 for an empty group."""
    return F.coalesce(F.percentile(F.col(value).cast("double"), F.lit(p / 100)), F.lit(0.0))


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate: the value at rank round(p (n - 1)), half away from zero."""
    ordered = F.array_sort(F.collect_list(F.col(value)))
    return F.get(ordered, F.round((F.size(ordered) - 1) * F.lit(p / 100)).cast("int"))


def nearest_ranks(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """nearest_rank() of each group as rows: values are counted first, so a group's distinct values are ranked, not its rows."""
    from pyspark.sql import Window

    own = Window.partitionBy(*keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.round((F.sum("_c").over(own) - 1) * F.lit(p / 100))
    placed = counted.withColumns({"_upto": upto, "_rank": rank}).filter("_upto > _rank")
    return placed.groupBy(*keys).agg(F.min(value).alias(name))


def windowed(df: DataFrame, key: str, at: str, vector: str) -> DataFrame:
    """Adds ``diff``: a cumulative vector less the one before it of the same key, never below 0; the first stands as it is."""
    from pyspark.sql import Window

    before = F.lag(vector).over(Window.partitionBy(key).orderBy(at))
    return df.withColumn("_before", before).withColumn("diff", F.when(F.col("_before").isNull(), F.col(vector)).otherwise(F.zip_with(vector, "_before", lambda x, y: F.greatest(x - y, F.lit(0))))).drop("_before")


def fleet_p99(total: Column, vector: Column, least_samples: int) -> Column:
    """The pooled 99th percentile, NULL below a number of samples."""
    return F.when(total >= least_samples, percentile(vector, 99))
