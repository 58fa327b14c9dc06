"""Row changes as projections: each returns the table's next version and the rows that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    fitted = rows.select(*(F.col(c).cast(table.schema[c].dataType).alias(c) if c in rows.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    return table.unionByName(fitted), fitted


def update(table: DataFrame, where: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """A NULL condition changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    marked = table.withColumn("_hit", hit)
    changed = marked.select("_hit", *(F.when(F.col("_hit"), changes[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns))
    return changed.drop("_hit"), changed.filter("_hit").drop("_hit")


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(where, F.lit(False))
    return table.filter(~hit), table.filter(hit)


def replace(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the same key give way; of several new rows with one key one stays."""
    new = insert(table.limit(0), rows)[1].dropDuplicates(keys)
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new), new
