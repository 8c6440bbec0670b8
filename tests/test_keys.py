from __future__ import annotations

from pyspark.sql import functions as F

from rangeweave.functions import keys, metrics, zipf
from rangeweave.operators.index import lookup, range_scan, upsert


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_days(spark):
    for text, day in (("1992-05-01", 1), ("1998-07-29", 2281), ("1992-04-30", 0), ("no date", None), ("", None)):
        assert one(spark, keys.text_day_ordinal(F.lit(text))) == day
    assert one(spark, keys.text_day_ordinal(F.lit("no date"), bad_as_one=True)) == 1


def test_bins(spark):
    got = spark.createDataFrame([(x,) for x in (0.999, 1.0, 10.0, 505.0, 1000.0, 1000.001)], "k double").select(keys.key_bin(F.col("k"), 10, 1000, 20).alias("b"), "k").collect()
    assert [r.b for r in got] == [-1, -1, 0, 10, 19, -1]


def test_csv4(spark):
    got = spark.createDataFrame([("s,1.5,1000,p",), ("s,x,y",), ("",)], "l string").select(keys.parse_csv4(F.col("l")).alias("x")).select("x.*").collect()
    assert (got[0].source, got[0].key, got[0].payload) == ("s", 1.5, "p") and got[0].ts.timestamp() == 1
    assert got[1].key is None and got[1].ts is None and got[1].payload is None and got[2].key is None


def test_pipe_lines(spark):
    line = "1|2|3|4|46|||||F|1992-05-03||||TRUCK|"
    df = spark.createDataFrame([(line,), ("short|line",)], "line string")
    assert [r.x.key for r in df.select(keys.parse_shipdate(F.col("line")).alias("x")).collect()] == [3.0, None]
    assert [r.x.key for r in df.select(keys.parse_suppkey(F.col("line")).alias("x")).collect()] == [3.0, None]
    assert keys.filter_l1(df, keys.pipe_field(F.col("line"), keys.SHIPMODE), keys.pipe_field(F.col("line"), keys.QUANTITY).try_cast("double")).count() == 1
    assert keys.filter_l2(df, keys.pipe_field(F.col("line"), keys.SHIPMODE)).count() == 0


def test_zipf(spark):
    cdf = {r.key: r for r in zipf.zipf_cdf(spark, 50, 0.9).collect()}
    assert abs(cdf[50].cdf - 1) < 1e-9 and cdf[1].probability > cdf[2].probability
    drawn = {r.key: r.n for r in zipf.zipf_sample(spark, 40_000, 50, 0.9, 3).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert min(drawn) >= 1 and max(drawn) <= 50
    assert all(abs(drawn.get(k, 0) / 40_000 - r.probability) < 0.012 for k, r in cdf.items())


def test_index_contract(spark):
    rows = spark.range(10_000).selectExpr("concat('i', id) AS item", "cast(id AS int) AS key", "id * 100 AS ts")
    assert range_scan(rows.filter("key <= 1000"), "key", 30, 30, "ts", 10_000).count() == 0
    assert [r.key for r in range_scan(rows, "key", 10, 150, "ts", 10_000).collect()] == list(range(100, 151))
    assert range_scan(rows, "key", 5, 4).count() == 0 and lookup(rows, "key", 7).count() == 1


def test_upsert_last_change_wins(spark):
    now = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 3, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in upsert(now, new, "k", F.col("v")).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_latency(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.2' AS at, 10L AS ms UNION ALL SELECT timestamp_ntz'2024-01-01 00:00:00.9', 15L UNION ALL SELECT timestamp_ntz'2024-01-01 00:00:02', 1L")
    got = metrics.latency_by_second(rows, "at", "ms").orderBy("window_start").collect()
    assert [(r.results, r.average) for r in got] == [(2, 12.5), (1, 1.0)]
    calendar = spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:02', INTERVAL 1 SECOND)) AS window_start")
    assert [r.average for r in metrics.latency_window_average(rows, "at", "ms", calendar=calendar).orderBy("window_start").collect()] == [12, -1, 1]
