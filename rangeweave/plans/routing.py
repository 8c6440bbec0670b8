"""Range routing: which partition owns which bin, since when, and where a probe must go.

Frames: a route table is (bin, partition); a history is (bin, partition, min_ts, max_ts), with FOREVER for an open end.
They have a row a bin and version, so the windows below that order all bins in one task stay small whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bandjoin import bounded_broadcast

FOREVER = 2**63 - 1
CLOSING_DELAY_MS = 300  # fixed: a closed version serves probes this much longer


def initial_route(spark: SparkSession, bins: int, partitions: int) -> DataFrame:
    """Contiguous runs, the first partitions one bin longer where it doesn't come out even."""
    return spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.ntile(partitions).over(Window.orderBy("id")) - 1).alias("partition"))


def bin_counts(route: DataFrame, partitions: int) -> DataFrame:
    """(partition, bins) for every partition, 0 where it owns none."""
    every = route.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    return every.join(route.groupBy("partition").agg(F.count(F.lit(1)).alias("bins")), "partition", "left").select("partition", F.coalesce("bins", F.lit(0)).alias("bins"))


def ranges(route: DataFrame) -> DataFrame:
    """(partition, left_bin, right_bin) on the ring of bins: a partition that wraps begins at its second run."""
    own = Window.partitionBy("partition").orderBy("bin")
    gaps = route.withColumn("before", F.lag("bin").over(own)).groupBy("partition").agg(
        F.min("bin").alias("low"), F.max("bin").alias("high"), F.min(F.when(F.col("bin") > F.col("before") + 1, F.col("bin"))).alias("again"), F.min(F.when(F.col("bin") > F.col("before") + 1, F.col("before"))).alias("upto")
    )
    return gaps.select("partition", F.coalesce("again", "low").alias("left_bin"), F.coalesce("upto", "high").alias("right_bin"))


def range_of(route: DataFrame, partition: int, bins: int) -> DataFrame:
    """(left_bin, right_bin) of one partition: (-1, -1) if it owns all bins, no row if none."""
    n = route.filter(F.col("partition") == partition).count()
    out = ranges(route).filter(F.col("partition") == partition)
    return out.select(*[(F.lit(-1) if n == bins else F.col(c)).alias(c) for c in ("left_bin", "right_bin")])


def shift(route: DataFrame, partition: int, n: int, partitions: int, forward: bool = True) -> DataFrame:
    """Give up to ``n`` of a partition's leftmost bins to the one before it, or of its rightmost to the next.

    Left and right go round the ring, as in ``ranges``.
    """
    edge = F.broadcast(ranges(route).filter(F.col("partition") == partition).select("left_bin"))
    place = F.when(F.col("bin") >= F.col("left_bin"), F.col("bin")).otherwise(F.col("bin") + F.lit(1 << 30))
    mine = route.filter(F.col("partition") == partition).crossJoin(edge).select("bin", F.row_number().over(Window.orderBy(place if forward else place.desc())).alias("n")).filter(F.col("n") <= n)
    to = (partition + (-1 if forward else 1)) % partitions
    return route.join(F.broadcast(mine.select("bin", F.lit(to).alias("to"))), "bin", "left").select("bin", F.coalesce("to", "partition").cast("int").alias("partition"))


def opened(route: DataFrame, watermark: int) -> DataFrame:
    """The first history of a route table."""
    return route.select("bin", "partition", F.lit(watermark).cast("long").alias("min_ts"), F.lit(FOREVER).alias("max_ts"))


def advance(history: DataFrame, route: DataFrame, min_watermark: int, max_watermark: int, delay: int = CLOSING_DELAY_MS) -> DataFrame:
    """Close every open version, then open the new table's: an owner that stays is reopened and keeps its beginning."""
    new = route.select("bin", "partition", F.lit(True).alias("stays"))
    was = history.join(new, ["bin", "partition"], "full")
    return was.select(
        "bin",
        "partition",
        F.coalesce("min_ts", F.lit(min_watermark)).cast("long").alias("min_ts"),
        F.when(F.col("stays"), F.lit(FOREVER)).when(F.col("max_ts") == FOREVER, F.lit(max_watermark + delay)).otherwise(F.col("max_ts")).cast("long").alias("max_ts"),
    )


def expire(history: DataFrame, watermark: int, window_ms: int) -> DataFrame:
    """Drop versions whose rows have all left the window."""
    return history.filter(F.col("max_ts") >= watermark - window_ms)


def fan_out(history: DataFrame, bins: int, width: float, below: float, above: float) -> DataFrame:
    """(bin, partition, min_ts, max_ts): where a probe from a bin must go, for any key in it."""
    reach = lambda edge: F.greatest(F.lit(0), F.least(F.lit(bins - 1), (edge / F.lit(width)).cast("int")))
    own = history.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    probes = own.withColumn("target", F.explode(F.sequence(reach(F.col("bin") * F.lit(width) - below), reach((F.col("bin") + 1) * F.lit(width) + above))))
    found = probes.join(history.withColumnRenamed("bin", "target"), "target")
    return found.groupBy("bin", "partition").agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def fan_out_at(fan: DataFrame, probes: DataFrame, ts: str, window_ms: int) -> DataFrame:
    """``probes`` (bin, a time in ms) with the partitions that may still hold rows in the window, bounds inclusive."""
    at = F.col(ts) - window_ms
    return probes.join(bounded_broadcast(fan), "bin").filter(F.col("max_ts") >= at).withColumn("min_ts", F.greatest("min_ts", at))


def replicated(rows: DataFrame, fan: DataFrame, route: DataFrame) -> DataFrame:
    """One copy of a row for each partition of its fan-out; the copy at its own partition is stored."""
    own = bounded_broadcast(route.select("bin", F.col("partition").alias("store_partition")))
    return rows.join(bounded_broadcast(fan.select("bin", "partition")), "bin").join(own, "bin").withColumn("mode", F.when(F.col("partition") == F.col("store_partition"), "store").otherwise("probe"))


def placed(rows: DataFrame, partition: str, partitions: int) -> DataFrame:
    """``rows`` in ``partitions`` tasks, each in the task that its ``partition`` (0, 1, ...) names; null ones are dropped."""
    return rows.filter(F.col(partition).isNotNull()).repartitionById(partitions, F.col(partition).cast("int"))
