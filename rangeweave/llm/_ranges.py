"""Ascending ranges of a long column, for any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = 200
MOST = 1 << 18


def range_of(df: DataFrame, column: str, rows_a_range: int, tie: Column | None = None) -> Column:
    """The number of a row's range: ranges are cut at quantiles, and then evenly, to about ``rows_a_range`` rows.

    There are at most ``MOST`` of them and what the quantiles add.  Nulls have ranges below all others, cut evenly by ``tie``, a
    hash, where it is given.  Rows that share a value are in one range.
    """
    cuts = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, full, bounds = df.agg(F.count(F.lit(1)), F.count(column), F.percentile_approx(column, cuts, 100 * QUANTILES)).first()
    bounds = sorted(set(bounds or [0]))
    split = max(1, min(MOST, n // rows_a_range) // len(bounds))
    value = F.col(column)
    at = F.aggregate(F.array(*map(F.lit, bounds)), F.lit(-1), lambda k, b: k + (b <= value).cast("int"))
    edges = F.array(*map(F.lit, [*bounds, bounds[-1] + 1]))
    low, high = (F.get(edges, F.greatest(at, F.lit(0)) + i).cast("double") for i in (0, 1))
    inner = F.least(F.lit(split - 1), F.greatest(F.lit(0), F.floor((value - low) / (high - low) * split).cast("int")))
    parts = 1 if tie is None else max(1, min(MOST, (n - full) // rows_a_range))
    below = F.lit(0) if parts == 1 else F.least(F.lit(parts - 1), F.floor((tie.cast("double") + 2.0**63) / 2.0**64 * parts).cast("int"))
    return F.when(value.isNull(), F.lit(-(1 << 40)) + below).when(value < bounds[0], F.lit(-1)).otherwise(at.cast("long") * split + inner).cast("long")
