from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from rangeweave.functions.metrics import JoinMonitor
from rangeweave.plans.balance import Balancer
from rangeweave.plans.routing import initial_route
from rangeweave.queries import QUERIES, event_pairs
from rangeweave.sources.readers import file_stream, rate_stream, union_streams
from rangeweave.sources.sinks import null_sink, parquet_sink
from rangeweave.streaming.join import run_to_end, stream_join, watch_load

SF = "/root/testdata/sf0.001"


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    bounds = events.approxQuantile("event_id", [0.25, 0.5, 0.75], 0)
    for i, (lo, hi) in enumerate(zip([-1, *bounds], [*bounds, 1 << 40])):  # files in the order of event time
        events.filter((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    monitor = JoinMonitor()
    spark.streams.addListener(monitor)
    r, s = (file_stream(spark, str(tmp_path / "in"), events.schema, 1).filter(F.col("event_type") == x) for x in ("click", "view"))
    joined = event_pairs(stream_join(r, s, r_key="value", s_key="value", surpass=1, behind=1, r_time="ts", s_time="ts", r_window="6 HOURS", s_window="6 HOURS"))
    query = run_to_end(parquet_sink(joined, str(tmp_path / "out"), str(tmp_path / "state")))
    spark.streams.removeListener(monitor)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, QUERIES["band_window_join"](spark, SF).collect()))
    assert got == want and len(got) == 14
    kept = [r for r in monitor.table(spark).collect() if r.query == str(query.id)]
    assert [r.batch for r in kept] == sorted({r.batch for r in kept}) and sum(r.input_rows for r in kept) > 0
    assert max(r.stored for r in kept) > 0 and sum(r.removed for r in kept) > 0 and sum(r.late for r in kept) == 0
    marks = [r.watermark for r in kept if r.watermark]
    assert marks == sorted(marks) and all(r.event_min <= r.event_max for r in kept if r.event_min)
    assert len(query.recentProgress) > 1 and sum(p.stateOperators[0].numRowsRemoved for p in query.recentProgress) > 0


def test_load_watcher_moves_bins(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(if(id % 10 = 0, id % 20, 3) AS int) AS bin")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = file_stream(spark, str(tmp_path / "in"), rows.schema)
    writer = watch_load(stream, F.col("bin"), Balancer(20, 4), initial_route(spark, 20, 4), str(tmp_path / "state"), lambda route, n: seen.append(route.count()))
    run_to_end(writer)
    assert seen == [20]


def test_union_and_rate(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "y string")
    got = sorted(union_streams(a, b).collect())
    assert [r.side for r in got] == ["R", "S"] and got[0].first.x == 1 and got[0].second is None and got[1].second.y == "q"
    rate = rate_stream(spark, 10)
    assert rate.isStreaming and rate.columns == ["source", "key", "ts", "payload"]
    assert null_sink(rate) is not None


ROW = "id long, k double, t timestamp"


def arrivals(spark, folder, *files):
    for rows in files:
        spark.createDataFrame([(i, k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, k, m in rows], ROW).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)


def joined(spark, at, delay="300 milliseconds"):
    r, s = (file_stream(spark, f"{at}/{x}", spark.createDataFrame([], ROW).schema, 1) for x in "rs")
    pairs = stream_join(r, s, r_key="k", s_key="k", surpass=1, behind=1, r_time="t", s_time="t", r_window="30 MINUTES", s_window="30 MINUTES", delay=delay)
    return pairs.select(F.col("r.id").alias("r"), F.col("s.id").alias("s"))


def test_late_rows_go_unless_the_delay_keeps_them(spark, tmp_path):
    for name, delay, want in (("short", "300 milliseconds", {(1, 10)}), ("long", "5 HOURS", {(1, 10), (3, 10)})):
        at = f"{tmp_path}/{name}"
        arrivals(spark, f"{at}/r", [(1, 1.0, 10)], [(2, 50.0, 240)], [(4, 50.0, 241)], [(3, 1.0, 12)])  # the last comes after its watermark
        arrivals(spark, f"{at}/s", [(10, 1.5, 11)], [(11, 90.0, 241)], [(12, 90.0, 242)], [(13, 90.0, 243)])
        monitor = JoinMonitor()
        spark.streams.addListener(monitor)
        query = run_to_end(parquet_sink(joined(spark, at, delay), f"{at}/out", f"{at}/state"))
        spark.streams.removeListener(monitor)
        assert {tuple(x) for x in spark.read.parquet(f"{at}/out").collect()} == want
        assert (sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators) > 0) == (name == "short")


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    at = str(tmp_path)
    arrivals(spark, f"{at}/r", [(1, 1.0, 10)])
    arrivals(spark, f"{at}/s", [(10, 90.0, 11)])
    run_to_end(parquet_sink(joined(spark, at), f"{at}/out", f"{at}/state"))
    assert spark.read.schema("r long, s long").parquet(f"{at}/out").count() == 0
    arrivals(spark, f"{at}/s", [(11, 1.5, 20)])  # meets the row that the first run stored
    run_to_end(parquet_sink(joined(spark, at), f"{at}/out", f"{at}/state"))
    assert {tuple(x) for x in spark.read.parquet(f"{at}/out").collect()} == {(1, 11)}
