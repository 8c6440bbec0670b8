"""The band join over streams, and salts that follow the load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.bandjoin import band_window_join
from ..plans.balance import Balancer, bin_load

DELAY = "300 milliseconds"  # fixed: how late rows may be


def timestamped(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read in the session's time zone, which should be UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def stream_join(r: DataFrame, s: DataFrame, *, r_time: str, s_time: str, delay: str = DELAY, **how) -> DataFrame:
    """``band_window_join`` of two streams with one delay.  Watermarks end the state of both sides.

    Rows later than the watermark are dropped; a longer delay keeps them.
    """
    return band_window_join(timestamped(r, r_time), timestamped(s, s_time), r_time=r_time, s_time=s_time, r_delay=delay, s_delay=delay, **how)


def run_to_end(writer: DataStreamWriter, timeout: int = 600) -> StreamingQuery:
    """Take in all that is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} s")
    if query.exception():
        raise query.exception()
    return query


def watch_load(rows: DataFrame, bin_of, balancer: Balancer, route: DataFrame, checkpoint: str, changed: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Decide between micro-batches: when load has drifted and is uneven, ``changed`` gets the new route table.

    A running join's state stays where it is; the new table, or more salt, is for the next query.
    """
    now = {"route": route}

    def each(batch: DataFrame, number: int) -> None:
        new = balancer.decide(bin_load([batch], bin_of, balancer.bins), now["route"])
        if new is not None:
            now["route"] = batch.sparkSession.createDataFrame(new.collect(), new.schema)  # a row a bin
            changed(now["route"], number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
