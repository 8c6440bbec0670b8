"""Keys, parsers and filters: plain column expressions, so that they push down and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the experiments: day ordinals count from this date, and keys lie in this domain
FIRST_DATE = "1992-05-01"
KEY_DOMAIN = (1.0, 2281.0)
KEY_BINS = 1280


def day_ordinal(date: Column, first: str = FIRST_DATE) -> Column:
    """Days since ``first``, which is day 1, of a date or time."""
    return F.datediff(date.cast("date"), F.lit(first).cast("date")) + 1


def text_day_ordinal(date: Column, first: str = FIRST_DATE, bad_as_one: bool = False) -> Column:
    """``day_ordinal`` of a yyyy-MM-dd string; anything else gives null, or 1 with ``bad_as_one``."""
    day = F.datediff(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date"), F.lit(first).cast("date")) + 1
    return F.coalesce(day, F.lit(1)) if bad_as_one else day


def key_bin(key: Column, low: float = KEY_DOMAIN[0], high: float = KEY_DOMAIN[1], bins: int = KEY_BINS) -> Column:
    """The range-hash bin of a key; the top edge falls into the last bin, keys outside the domain into -1."""
    width = (high - low) / bins
    return F.when((key >= low) & (key <= high), F.least(((key - low) / F.lit(width)).cast("int"), F.lit(bins - 1))).otherwise(F.lit(-1))


def in_domain(key: Column, low: float = KEY_DOMAIN[0], high: float = KEY_DOMAIN[1]) -> Column:
    return key.between(low, high)


def parse_csv4(line: Column) -> Column:
    """``source,key,epoch-ms,payload`` as a struct; malformed numbers give nulls."""
    part = F.split(line, ",")
    return F.struct(
        F.get(part, F.lit(0)).alias("source"),
        F.get(part, F.lit(1)).try_cast("double").alias("key"),
        F.timestamp_millis(F.get(part, F.lit(2)).try_cast("bigint")).alias("ts"),
        F.get(part, F.lit(3)).alias("payload"),
    )


# fixed places in a |-separated line
SUPPKEY, QUANTITY, SHIPDATE, SHIPMODE = 2, 4, 10, 14


def pipe_field(line: Column, place: int) -> Column:
    return F.get(F.split(line, "\\|"), F.lit(place))


def parse_shipdate(line: Column, ts: Column | None = None, bad_as_one: bool = False) -> Column:
    """A lineitem line keyed by its ship date; without ``ts`` the time of parsing."""
    return F.struct(text_day_ordinal(pipe_field(line, SHIPDATE), bad_as_one=bad_as_one).cast("double").alias("key"), (F.current_timestamp() if ts is None else ts).alias("ts"), line.alias("payload"))


def parse_suppkey(line: Column, ts: Column | None = None) -> Column:
    """A lineitem line keyed by its supplier."""
    return F.struct(pipe_field(line, SUPPKEY).try_cast("double").alias("key"), (F.current_timestamp() if ts is None else ts).alias("ts"), line.alias("payload"))


def filter_l1(df: DataFrame, mode: Column, quantity: Column, wanted: str = "TRUCK", over: float = 45) -> DataFrame:
    return df.filter((mode == wanted) & (quantity > over))


def filter_l2(df: DataFrame, mode: Column, unwanted: str = "TRUCK") -> DataFrame:
    return df.filter(mode != unwanted)


def filter_nonempty_key(df: DataFrame, key: Column) -> DataFrame:
    return df.filter(F.length(key) > 0)
