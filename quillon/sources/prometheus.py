"""Metrics in text form: ``name{labels} value`` lines as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{.*\})?\s+(\S+)$"


def parse(lines: DataFrame, text: str = "value") -> DataFrame:
    """name, labels (map), value; lines that don't fit and NaN drop out, both infinities stay."""
    line = F.trim(F.col(text))
    label_text = F.regexp_replace(F.regexp_extract(line, LINE, 2), r"^\{|\}$", "")
    pairs = F.transform(F.filter(F.split(label_text, ","), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.regexp_replace(F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))), '^"+|"+$', "").alias("v")))
    number = F.regexp_extract(line, LINE, 3)
    value = F.when(number == "+Inf", F.lit(float("inf"))).when(number == "-Inf", F.lit(float("-inf"))).when(number == "NaN", F.lit(None)).otherwise(F.regexp_extract(number, r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", 0).try_cast("double"))
    rows = lines.filter(line.rlike(LINE)).select(F.regexp_extract(line, LINE, 1).alias("name"), F.map_from_entries(pairs).alias("labels"), value.alias("value"))
    return rows.filter("value IS NOT NULL")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def _matches(labels: dict[str, str]) -> Column:
    found = F.lit(True)
    for k, v in labels.items():
        found = found & F.col("labels").getItem(k).eqNullSafe(F.lit(v))
    return found


def value(samples: DataFrame, prefix: str, labels: dict[str, str] | None = None, default: float = 0.0) -> DataFrame:
    """The value of a family by prefix whose labels hold the given ones; one row, with the default if there is none."""
    rows = samples.filter(F.col("name").startswith(prefix) & ~F.col("name").endswith("_bucket") & _matches(labels or {}))
    return rows.agg(F.coalesce(F.min_by("value", F.struct("name", F.to_json("labels"))), F.lit(default)).alias("value"))


def label_values(samples: DataFrame, prefix: str, key: str) -> DataFrame:
    return samples.filter(F.col("name").startswith(prefix) & F.map_contains_key("labels", key)).select(F.col("labels").getItem(key).alias("label")).distinct()


def buckets(samples: DataFrame, prefix: str) -> DataFrame:
    """One row: buckets, an array of (le, cum) in ascending order, infinity last."""
    rows = samples.filter(F.col("name").startswith(prefix) & F.col("name").endswith("_bucket") & F.map_contains_key("labels", "le"))
    le = F.col("labels").getItem("le")
    number = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.try_cast("double"))
    return rows.agg(F.array_sort(F.collect_list(F.struct(number.alias("le"), F.col("value").alias("cum")))).alias("buckets"))
