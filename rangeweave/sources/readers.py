"""Sources: Kafka topics, files, the rate generator, and any frame in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def kafka_lines(spark: SparkSession, servers: str, topic: str, group: str = "test_group_1", starting: str = "latest", options: dict[str, str] | None = None) -> DataFrame:
    """A stream of (line, kafka_ts) of a topic's values.  Needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("kafka.group.id", group)
    return reader.options(**(options or {})).load().select(F.col("value").cast("string").alias("line"), F.col("timestamp").alias("kafka_ts"))


def file_stream(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int | None = None, format: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).load(path)


def text_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path).withColumnRenamed("value", "line")


def rate_stream(spark: SparkSession, rows_a_second: int = 100_000, partitions: int = 3, low: float = 1.0, high: float = 2281.0) -> DataFrame:
    """(source, key, ts, payload): keys spread over a domain by a hash of the row's number."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).option("numPartitions", partitions).load()
    share = F.pmod(F.xxhash64("value"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.select(F.lit("rate").alias("source"), (F.lit(low) + share * (high - low)).alias("key"), F.col("timestamp").alias("ts"), F.col("value").cast("string").alias("payload"))


def stamped(df: DataFrame, column: str = "ingest_ts") -> DataFrame:
    """Rows with the time at which they were taken in, from which latency is measured; alike within a micro-batch."""
    return df.withColumn(column, F.current_timestamp())


def union_streams(r: DataFrame, s: DataFrame, ingest: str | None = None) -> DataFrame:
    """Both sides in one frame: ``side`` R or S, and a struct each, one of them null; with ``ingest``, that column too."""
    if ingest is not None:
        return stamped(union_streams(r, s), ingest)
    r_row, s_row = F.struct(*r.columns), F.struct(*s.columns)
    left = r.select(F.lit("R").alias("side"), r_row.alias("first"), F.lit(None).cast(s.select(s_row.alias("x")).schema["x"].dataType).alias("second"))
    return left.unionByName(s.select(F.lit("S").alias("side"), F.lit(None).cast(r.select(r_row.alias("x")).schema["x"].dataType).alias("first"), s_row.alias("second")))
