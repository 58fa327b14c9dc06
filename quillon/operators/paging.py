"""Pages, caps and top rows over a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST_PAGE, USUAL_PAGE = 200, 50


class ResultTooLarge(Exception):
    """The result has more rows than the cap."""


def page(df: DataFrame, order: list[Column | str], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page, and one row more if there is a next page; the limit is kept within 1..200, the offset at 0 or more."""
    size = min(max(USUAL_PAGE if limit is None else limit, 1), LARGEST_PAGE)
    return df.orderBy(*order).offset(max(offset or 0, 0)).limit(size + 1)


def after(df: DataFrame, key: str, last: object, limit: int) -> DataFrame:
    """The next rows by key."""
    rows = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(limit)


def top(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def capped(df: DataFrame, cap: int) -> list:
    """All rows, or ResultTooLarge; no more than cap + 1 rows leave the executors."""
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ResultTooLarge(f"over {cap} rows")
    return rows


def truncated(df: DataFrame, cap: int = 1000) -> tuple[list, bool]:
    """The first rows, and whether there are more."""
    rows = df.limit(cap + 1).collect()
    return rows[:cap], len(rows) > cap


def least_recent(df: DataFrame, touched: str, busy: str, live: str, n: int, tie: str) -> DataFrame:
    """Eviction candidates: live and not busy, the least recently touched first."""
    return df.filter(~F.col(busy) & F.col(live)).orderBy(touched, tie).limit(n)


def top_and_total(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first rows, each with the number of all rows."""
    return top(df, order, n).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
