"""Row generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sequence(spark: SparkSession, first: int, last: int) -> DataFrame:
    """x from first to last; a range, where recursion would be bounded by a level limit."""
    return spark.range(first, last + 1).withColumnRenamed("id", "x")


def zipf(spark: SparkSession, ranks: int, draws: int, exponent: float, seed: int = 1) -> DataFrame:
    """``draws`` ranks (1 the most frequent), each found among the cumulative shares by an equality join on cells of the unit interval."""
    weight = spark.range(1, ranks + 1).select(F.col("id").alias("rank"), (1 / F.pow(F.col("id").cast("double"), F.lit(float(exponent)))).alias("w"))
    # the cumulative shares, a row a rank, as buckets of one in ``ranks`` of the unit interval: a draw looks into its own bucket
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    shares = weight.withColumn("high", F.sum("w").over(upto) / F.sum("w").over(Window.partitionBy())).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("rank")), F.lit(0.0)))
    cell = lambda x: F.floor(x * ranks).cast("long")
    table = shares.select("rank", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    drawn = spark.range(draws).withColumn("u", F.rand(seed)).withColumn("cell", cell(F.col("u")))
    inside = (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | (F.col("rank") == ranks))
    return drawn.join(table, "cell").filter(inside).select("id", F.col("rank").cast("int").alias("rank"))
