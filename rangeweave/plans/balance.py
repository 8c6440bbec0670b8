"""Load statistics and the rebalancing plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import ranges

# fixed values of the experiments
DRIFT, IMBALANCE = 0.2, 0.2


def bin_load(rows: list[DataFrame], bin_of: Column, bins: int) -> DataFrame:
    """(bin, load): stored rows of all inputs.  Each input is counted before they meet, so one small shuffle is left."""
    clamped = F.greatest(F.lit(0), F.least(F.lit(bins - 1), bin_of)).alias("bin")
    parts = [df.groupBy(clamped).agg(F.count(F.lit(1)).alias("n")) for df in rows]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("bin").agg(F.sum("n").cast("double").alias("load"))


def dense(load: DataFrame, bins: int) -> DataFrame:
    every = load.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(load.groupBy("bin").agg(F.sum("load").alias("load")), "bin", "left").select("bin", F.coalesce("load", F.lit(0.0)).alias("load"))


def parse_load(text: Column) -> Column:
    """``"bin load;bin load;"`` as an array of (bin, load); an empty string has none."""
    entries = F.filter(F.split(text, ";"), lambda x: F.length(F.trim(x)) > 0)
    return F.transform(entries, lambda x: F.struct(F.split(F.trim(x), " ")[0].cast("int").alias("bin"), F.split(F.trim(x), " ")[1].cast("double").alias("load")))


def format_load(load: DataFrame) -> DataFrame:
    """One row, (load), with the text that ``parse_load`` reads."""
    entry = F.transform(F.array_sort(F.collect_list(F.struct("bin", "load"))), lambda x: F.concat(x["bin"].cast("string"), F.lit(" "), x["load"].cast("string"), F.lit(";")))
    return load.agg(F.array_join(entry, "").alias("load"))


def partition_load(load: DataFrame, route: DataFrame, partitions: int) -> DataFrame:
    """(partition, load, left_bin, right_bin); 0 and nulls for a partition without bins."""
    every = load.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition"))
    sums = route.join(load, "bin", "left").groupBy("partition").agg(F.sum(F.coalesce("load", F.lit(0.0))).alias("load"))
    return every.join(sums, "partition", "left").join(ranges(route), "partition", "left").select("partition", F.coalesce("load", F.lit(0.0)).alias("load"), "left_bin", "right_bin")


def imbalance(loads: DataFrame, threshold: float = IMBALANCE) -> DataFrame:
    """One row (average, factor, unbalanced) over all partitions; nothing is unbalanced without load."""
    out = loads.agg(F.max("load").alias("most"), F.avg("load").alias("average"))
    factor = F.when(F.col("average") != 0, F.abs(F.col("most") - F.col("average")) / F.col("average"))
    return out.select("average", F.coalesce(factor, F.lit(0.0)).alias("factor"), F.coalesce(factor > threshold, F.lit(False)).alias("unbalanced"))


def drift(last: DataFrame | None, new: DataFrame, threshold: float = DRIFT) -> DataFrame:
    """One row (moved, total, drifted).  Without a last load, or with an empty one, the load counts as drifted."""
    if last is None:
        last = new.select("bin", F.lit(0.0).alias("load"))
    both = last.select("bin", F.col("load").alias("a")).join(new.select("bin", F.col("load").alias("b")), "bin", "full").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    sums = both.agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("moved"), F.sum("a").alias("total"))
    return sums.select("moved", "total", F.when(F.coalesce("total", F.lit(0.0)) == 0, True).otherwise(F.col("moved") / F.col("total") > threshold).alias("drifted"))


def rebalanced(load: DataFrame, route: DataFrame, partitions: int) -> DataFrame:
    """A new route table: bins in ring order, from the first owning partition's left bin, go to a partition until it has
    the average load; then the next one's turn comes, round the ring.

    The pass is sequential over one row a bin, as a fold inside Catalyst.
    """
    start = ranges(route).agg(F.min(F.struct("partition", "left_bin")).alias("s")).select(F.col("s.partition").alias("first"), F.col("s.left_bin").alias("left_bin"))
    ring = load.crossJoin(F.broadcast(start)).groupBy("first").agg(
        F.array_sort(F.collect_list(F.struct(F.when(F.col("bin") >= F.col("left_bin"), 0).otherwise(1).alias("round"), "bin", "load"))).alias("ring"), (F.sum("load") / partitions).alias("average")
    )
    fold = f"""aggregate(ring, named_struct('p', first, 'acc', 0D, 'out', cast(array() as array<struct<bin: int, partition: int>>)), (s, x) ->
        named_struct('p', if(s.acc + x.load >= average, pmod(s.p + 1, {partitions}), s.p), 'acc', if(s.acc + x.load >= average, 0D, s.acc + x.load),
                     'out', concat(s.out, array(named_struct('bin', x.bin, 'partition', s.p)))), s -> s.out)"""
    return ring.select(F.explode(F.expr(fold)).alias("x")).select("x.bin", "x.partition")


@dataclass
class Balancer:
    """The decision between batches: drift, then imbalance, then a new table.  Only one row a bin comes to the driver's plan."""

    bins: int
    partitions: int
    drift: float = DRIFT
    imbalance: float = IMBALANCE
    enabled: bool = True
    last: DataFrame | None = None

    def decide(self, load: DataFrame, route: DataFrame) -> DataFrame | None:
        """A new route table, or None.  The load becomes the baseline whenever it has drifted, whatever follows."""
        if not self.enabled:
            return None
        load = dense(load, self.bins)
        if not drift(self.last, load, self.drift).first()["drifted"]:
            return None
        self.last = load.sparkSession.createDataFrame(load.collect(), load.schema)
        loads = partition_load(self.last, route, self.partitions)
        return rebalanced(self.last, route, self.partitions) if imbalance(loads, self.imbalance).first()["unbalanced"] else None
