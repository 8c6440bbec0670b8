"""Zipf-skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def zipf_cdf(spark: SparkSession, n: int, skew: float) -> DataFrame:
    """(key, probability, cdf) for keys 1..n; one task orders the n keys, whatever the size of the sample."""
    mass = spark.range(1, n + 1).select(F.col("id").cast("int").alias("key"), F.pow(F.col("id").cast("double"), F.lit(-skew)).alias("m"))
    total = mass.agg(F.sum("m").alias("total"))
    upto = F.sum("m").over(Window.orderBy("key"))
    return mass.crossJoin(F.broadcast(total)).select("key", (F.col("m") / F.col("total")).alias("probability"), (upto / F.col("total")).alias("cdf"))


def uniform(number: Column, seed: int = 0) -> Column:
    """52 bits of a hash, from 0 to 1."""
    digits = F.substring(F.md5(F.concat(number.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**52)


def zipf_sample(spark: SparkSession, rows: int, n: int, skew: float, seed: int = 0) -> DataFrame:
    """(id, key): ``rows`` draws, each from a hash of its id and the seed, so they are alike however they are dealt.

    The cdf's n bounds ride along as one array and are bisected in place, with no join.
    """
    bounds = zipf_cdf(spark, n, skew).agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "cdf"))), lambda x: x["cdf"]).alias("bounds"))
    draws = spark.range(rows).withColumn("u", uniform(F.col("id"), seed)).crossJoin(F.broadcast(bounds))
    state = "named_struct('lo', 0, 'hi', size(bounds) - 1)"
    step = "if(s.lo >= s.hi, s, if(bounds[(s.lo + s.hi) div 2] >= u, named_struct('lo', s.lo, 'hi', int((s.lo + s.hi) div 2)), named_struct('lo', int((s.lo + s.hi) div 2 + 1), 'hi', s.hi)))"
    steps = max(1, n).bit_length()
    return draws.select("id", F.expr(f"aggregate(sequence(1, {steps}), {state}, (s, i) -> {step}).lo + 1").alias("key"))
