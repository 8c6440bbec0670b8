"""Latency and throughput of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def latency_ms(now: Column, ingested: Column) -> Column:
    return (F.unix_millis(now.cast("timestamp")) - F.unix_millis(ingested.cast("timestamp"))).alias("latency_ms")


def latency_by_second(df: DataFrame, ts: str, latency: str, by: str | None = None, every: str = "1 second") -> DataFrame:
    """(window_start, window_end, [by], results, average) in fixed windows; works on streams with a watermark."""
    keys = [F.window(ts, every).alias("w"), *([F.col(by)] if by else [])]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("results"), F.avg(latency).alias("average"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *([by] if by else []), "results", "average")


def latency_window_average(df: DataFrame, ts: str, latency: str, every: str = "1 second", calendar: DataFrame | None = None) -> DataFrame:
    """Whole-number averages by window; windows of ``calendar`` (window_start) without results give -1."""
    own = df.groupBy(F.window(ts, every).alias("w")).agg(F.expr(f"sum({latency}) div count(*)").alias("average")).select(F.col("w.start").alias("window_start"), "average")
    return own if calendar is None else calendar.join(own, "window_start", "left").select("window_start", F.coalesce("average", F.lit(-1)).alias("average"))


class JoinMonitor(StreamingQueryListener):
    """Keeps each batch's rates, stored rows, evicted rows and rows that came too late, by query id."""

    def __init__(self, most: int = 1000):
        self.most, self.progress = most, {}

    def onQueryStarted(self, event) -> None:
        self.progress.setdefault(str(event.id), [])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        kept = self.progress.setdefault(str(p.id), [])
        kept.append({
            "batch": p.batchId, "input_rate": p.inputRowsPerSecond, "processed_rate": p.processedRowsPerSecond, "input_rows": p.numInputRows,
            "watermark": p.eventTime.get("watermark"), "event_min": p.eventTime.get("min"), "event_max": p.eventTime.get("max"),
            "stored": sum(s.numRowsTotal for s in p.stateOperators), "removed": sum(s.numRowsRemoved for s in p.stateOperators), "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        })
        del kept[: -self.most]

    def table(self, spark: SparkSession) -> DataFrame:
        """What was kept, a row a query and batch: (query, batch, input_rows, rates, watermark, event_min, event_max, stored, removed, late)."""
        kind = "query string, batch long, input_rows long, input_rate double, processed_rate double, watermark string, event_min string, event_max string, stored long, removed long, late long"
        names = [x.split()[0] for x in kind.split(", ")]
        return spark.createDataFrame([tuple({"query": q, **row}[c] for c in names) for q, rows in self.progress.items() for row in rows], kind)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
