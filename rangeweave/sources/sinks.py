"""Sinks of streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Rows as JSON values.  Needs Spark's Kafka connector."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)


def parquet_sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def text_sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def console_sink(df: DataFrame) -> DataStreamWriter:
    return df.writeStream.format("console")


def null_sink(df: DataFrame) -> DataStreamWriter:
    return df.writeStream.format("noop")
