"""Aggregates that refuse text, skip NULL, and are NULL over an empty group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind not in NUMERIC and not kind.startswith("decimal"):
        raise TypeError(f"{name} is {kind}; a number is asked for")
    return F.col(name)


def statistic(df: DataFrame, kind: str, name: str) -> Column:
    """stddev_pop, stddev_samp, var_pop or var_samp of a numeric column."""
    return getattr(F, kind)(_number(df, name).cast("double"))


def bits(df: DataFrame, kind: str, name: str) -> Column:
    """bit_and, bit_or or bit_xor; reals are cut to integers first."""
    return getattr(F, kind)(_number(df, name).cast("bigint"))


def any_known(name: str) -> Column:
    """Some value of the group that isn't NULL."""
    return F.any_value(name, ignoreNulls=True)
