"""Directory writes as projections: each takes the table and a batch, and returns the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_wins(table: DataFrame, batch: DataFrame, key: str, column: str, defaults: dict[str, Column]) -> DataFrame:
    """Upsert one time column by its greatest value; unseen keys come in with defaults, known ones keep the rest."""
    newest = batch.groupBy(key).agg(F.max(column).alias("_new"))
    joined = table.join(newest, key, "full_outer")
    fresh = table.select(key).withColumn("_known", F.lit(True))
    joined = joined.join(fresh, key, "left")
    known = F.coalesce("_known", F.lit(False))
    columns = [F.greatest(column, "_new").alias(c) if c == column else F.col(key) if c == key else F.when(known, F.col(c)).otherwise(defaults.get(c, F.lit(None))).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    return joined.select(*columns)


def touch(table: DataFrame, batch: DataFrame, key: str, column: str) -> DataFrame:
    """Move one column of known keys forward; unseen keys are ignored."""
    newest = batch.groupBy(key).agg(F.max(column).alias("_new"))
    return table.join(newest, key, "left").withColumn(column, F.greatest(column, "_new")).select(*table.columns)


def increment(table: DataFrame, keys: DataFrame, key: str, counter: str, first: int = 1) -> DataFrame:
    """Insert unseen keys at ``first`` and add one to all given keys."""
    given = keys.select(key).distinct().withColumn("_given", F.lit(True))
    joined = table.join(given, key, "full_outer")
    return joined.withColumn(counter, F.coalesce(counter, F.lit(first)) + F.coalesce("_given", F.lit(False)).cast("int")).select(*table.columns)


def replaced_members(table: DataFrame, members: DataFrame, owner: str, of: list | None = None) -> DataFrame:
    """An owner's rows become exactly the given ones; other owners' rows stay.

    of: the owners that publish, so that an empty set sweeps an owner's rows; None: those of the given rows.
    """
    gone = table.join(members.select(owner).distinct(), owner, "left_anti") if of is None else table.filter(~F.coalesce(F.col(owner).isin(of), F.lit(False)))
    return gone.unionByName(members)


def tombstoned(table: DataFrame, keys: DataFrame, key: str, status: str = "deleted") -> DataFrame:
    """The given keys get the status; those unseen come in with it."""
    given = keys.select(key).distinct().withColumn("_given", F.lit(True))
    joined = table.join(given, key, "full_outer")
    return joined.select(*(F.when(F.col("_given"), F.lit(status)).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in table.columns))


def pruned_terminal(table: DataFrame, at: str, before: object, states: list[str]) -> DataFrame:
    """Without rows in a terminal state that are older than ``before``."""
    return table.filter(~F.coalesce(F.col("state").isin(states) & (F.col(at) < F.lit(before)), F.lit(False)))


def expired(table: DataFrame, at: str, before: object) -> DataFrame:
    """Pending rows older than ``before`` become expired."""
    return table.withColumn("state", F.when((F.col("state") == "pending") & (F.col(at) < F.lit(before)), "expired").otherwise(F.col("state")))


def conditional(table: DataFrame, where: Column, changes: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The table with changes applied where the condition holds, and the rows that changed."""
    hit = F.coalesce(where, F.lit(False))
    after = table.withColumn("_hit", hit).withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()})
    return after.drop("_hit"), after.filter("_hit").drop("_hit")


def pruned(table: DataFrame, at: str, before: object, owner: str | None = None, of: str | None = None, everyone_before: object = None) -> DataFrame:
    """Without rows older than ``before`` (of one owner, if given) and, if given, anyone's older than ``everyone_before``."""
    old = F.col(at) < F.lit(before)
    if owner is not None:
        old = old & (F.col(owner) == F.lit(of))
    if everyone_before is not None:
        old = old | (F.col(at) < F.lit(everyone_before))
    return table.filter(~F.coalesce(old, F.lit(False)))


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Hard delete by exact key."""
    return table.join(keys.select(key).distinct(), key, "left_anti")
