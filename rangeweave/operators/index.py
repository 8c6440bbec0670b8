"""The contract of an ordered index, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_scan(df: DataFrame, key: str, low, high, ts: str | None = None, since=None) -> DataFrame:
    """Rows with low <= key <= high (and ts >= since), by key; none if low > high."""
    rows = df.filter(F.col(key).between(low, high))
    return (rows if ts is None else rows.filter(F.col(ts) >= since)).orderBy(key)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: the change that ``order`` puts last, else the current row.  Changes win over current rows."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("_new"), order.desc())
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)
