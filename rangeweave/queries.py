"""The registered queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, metrics, zipf
from .operators.bandjoin import band_window_join, bounded_broadcast
from .operators.index import lookup, range_scan, upsert
from .plans import balance, routing
from .sources.readers import file_stream, union_streams
from .sources.sinks import parquet_sink
from .streaming.join import run_to_end, stream_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BINS, PARTITIONS = keys.KEY_BINS, 16
LOW, HIGH = keys.KEY_DOMAIN
WIDTH = (HIGH - LOW) / BINS


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- lineitem, keyed by its ship date


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("day", keys.day_ordinal(F.col("l_shipdate")))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """L1 and L2; the return flag stands in for the ship mode, which the table doesn't have."""
    rows = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "day")
    flag = F.col("l_returnflag")
    return tuple(x.select("l_orderkey", "l_linenumber", "day") for x in (keys.filter_l1(rows, flag, F.col("l_quantity"), "R"), keys.filter_l2(rows, flag, "R")))


DAY = "CAST(datediff('day', DATE '1992-05-01', l_shipdate) + 1 AS INTEGER)"
SIDES = f"""
l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, {DAY} AS day FROM lineitem),
r AS (SELECT * FROM l WHERE l_returnflag = 'R' AND l_quantity > 45),
s AS (SELECT * FROM l WHERE l_returnflag <> 'R')"""
PAIR = "r.l_orderkey AS r_orderkey, r.l_linenumber AS r_linenumber, r.day AS r_day, s.l_orderkey AS s_orderkey, s.l_linenumber AS s_linenumber, s.day AS s_day"


def day_pairs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"{x}.{c}").alias(f"{x}_{c.removeprefix('l_')}") for x in "rs" for c in ("l_orderkey", "l_linenumber", "day")])


@query(f"WITH {SIDES} SELECT {PAIR} FROM r JOIN s ON s.day >= r.day - 1 AND s.day <= r.day + 1")
def tpch_band_join_shipdate(spark, sf_dir):
    r, s = sides(spark, sf_dir)
    return day_pairs(band_window_join(r, s, "day", "day", 1, 1))


@query(f"WITH {SIDES} SELECT {PAIR} FROM r JOIN s ON s.day >= r.day - 1 AND s.day <= r.day + 1 WHERE r.day BETWEEN 1 AND 2281 AND s.day BETWEEN 1 AND 2281")
def key_domain_filter(spark, sf_dir):
    r, s = sides(spark, sf_dir)
    return day_pairs(band_window_join(r, s, "day", "day", 1, 1, key_domain=keys.KEY_DOMAIN))


@query(f"WITH {SIDES} SELECT {PAIR} FROM r JOIN s ON s.day >= r.day - 1 AND s.day <= r.day + 1")
def band_join_salted(spark, sf_dir):
    r, s = sides(spark, sf_dir)
    return day_pairs(band_window_join(r, s, "day", "day", 1, 1, salt=4))


@query(f"WITH {SIDES} SELECT {PAIR} FROM r JOIN s ON s.day >= r.day - 1 AND s.day <= r.day + 1 WHERE r.day BETWEEN 1 AND 2281 AND s.day BETWEEN 1 AND 2281")
def band_join_routed(spark, sf_dir):
    r, s = sides(spark, sf_dir)
    route = routing.initial_route(spark, BINS, PARTITIONS)
    bin_of = lambda k: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((k - LOW) / F.lit(WIDTH)).cast("int")))
    return day_pairs(band_window_join(r, s, "day", "day", 1, 1, strategy="routed", route=route, route_bin=bin_of, key_domain=keys.KEY_DOMAIN))


@query(f"SELECT l_orderkey, l_linenumber, {DAY} AS day FROM lineitem")
def day_ordinal(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "day")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def filter_l1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return keys.filter_l1(rows, rows["l_returnflag"], rows["l_quantity"], "R").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'")
def filter_l2(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return keys.filter_l2(rows, rows["l_returnflag"], "R").select("l_orderkey", "l_linenumber", "l_returnflag")


KEY_TEXT = "CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END"


@query(f"SELECT * FROM (SELECT event_id, {KEY_TEXT} AS key FROM events) WHERE length(key) > 0")
def filter_nonempty_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("user_id").cast("string")).alias("key"))
    return keys.filter_nonempty_key(rows, F.col("key"))


@query("""
WITH t AS (SELECT event_type || ',' || CAST(user_id AS VARCHAR) || ',' || CAST(epoch_us(ts) // 1000 AS VARCHAR) || ',' || CAST(event_id AS VARCHAR) AS line FROM events)
SELECT split_part(line, ',', 1) AS source, CAST(split_part(line, ',', 2) AS DOUBLE) AS key, CAST(split_part(line, ',', 3) AS BIGINT) AS ts_ms, split_part(line, ',', 4) AS payload FROM t
""")
def parse_csv4(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    line = F.concat_ws(",", "event_type", F.col("user_id").cast("string"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.col("event_id").cast("string"))
    return rows.select(keys.parse_csv4(line).alias("x")).select("x.source", "x.key", F.unix_millis("x.ts").alias("ts_ms"), "x.payload")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as |-separated text, empty where the table has no column."""
    part = [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")]
    part += [F.lit("")] * 3 + [F.col("l_returnflag"), F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(""), F.lit(""), F.lit(""), F.when(F.col("l_returnflag") == "R", "TRUCK").otherwise("MAIL"), F.lit("")]
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("|", *[p.cast("string") for p in part]).alias("line"))


LINES = """t AS (SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER), '', '', '', l_returnflag, l_linestatus,
    strftime(l_shipdate, '%Y-%m-%d'), '', '', '', CASE WHEN l_returnflag = 'R' THEN 'TRUCK' ELSE 'MAIL' END, '') AS line FROM lineitem)"""


@query(f"WITH {LINES} SELECT CAST(datediff('day', DATE '1992-05-01', CAST(split_part(line, '|', 11) AS DATE)) + 1 AS DOUBLE) AS key, line AS payload FROM t WHERE split_part(line, '|', 15) = 'TRUCK' AND CAST(split_part(line, '|', 5) AS DOUBLE) > 45")
def tpch_shipdate_key(spark, sf_dir):
    rows = lines(spark, sf_dir)
    rows = keys.filter_l1(rows, keys.pipe_field(F.col("line"), keys.SHIPMODE), keys.pipe_field(F.col("line"), keys.QUANTITY).try_cast("double"))
    return rows.select(keys.parse_shipdate(F.col("line")).alias("x")).select("x.key", "x.payload")


@query(f"WITH {LINES} SELECT CAST(split_part(line, '|', 3) AS DOUBLE) AS key, line AS payload FROM t")
def tpch_suppkey_key(spark, sf_dir):
    return lines(spark, sf_dir).select(keys.parse_suppkey(F.col("line")).alias("x")).select("x.key", "x.payload")


# ---------------------------------------------------------------- events: clicks and views


def clicks_and_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'")


EVENTS = "r AS (SELECT * FROM events WHERE event_type = 'click'), s AS (SELECT * FROM events WHERE event_type = 'view')"
EVENT_PAIR = "r.event_id AS r_id, s.event_id AS s_id, r.value AS r_value, s.value AS s_value"


def event_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("r.event_id").alias("r_id"), F.col("s.event_id").alias("s_id"), F.col("r.value").alias("r_value"), F.col("s.value").alias("s_value"))


def theta(surpass, behind, r_window, s_window, key="value") -> str:
    return f"FROM r JOIN s ON s.{key} >= r.{key} - {surpass} AND s.{key} <= r.{key} + {behind} AND s.ts >= r.ts - INTERVAL {s_window} AND r.ts >= s.ts - INTERVAL {r_window}"


def windowed(spark, sf_dir, surpass, behind, r_window, s_window, key="value", **how) -> DataFrame:
    r, s = clicks_and_views(spark, sf_dir)
    return band_window_join(r, s, key, key, surpass, behind, "ts", "ts", r_window, s_window, **how)


@query(f"WITH {EVENTS} SELECT {EVENT_PAIR} {theta(1, 1, '6 HOURS', '6 HOURS')}")
def band_window_join_binned(spark, sf_dir):
    return event_pairs(windowed(spark, sf_dir, 1, 1, "6 HOURS", "6 HOURS"))


@query(f"WITH {EVENTS} SELECT {EVENT_PAIR} {theta(2, 0.5, '1 HOUR', '4 HOURS')}")
def band_window_join_asym(spark, sf_dir):
    return event_pairs(windowed(spark, sf_dir, 2, 0.5, "1 HOUR", "4 HOURS"))


@query(f"WITH {EVENTS} SELECT {EVENT_PAIR} {theta(0, 0, '1 DAY', '1 DAY', 'user_id')}")
def equi_window_join(spark, sf_dir):
    return event_pairs(windowed(spark, sf_dir, 0, 0, "1 DAY", "1 DAY", "user_id"))


@query(f"WITH {EVENTS} SELECT {EVENT_PAIR} {theta(1, 1, '6 HOURS', '6 HOURS')}")
def band_window_join_tumbled(spark, sf_dir):
    return event_pairs(windowed(spark, sf_dir, 1, 1, "6 HOURS", "6 HOURS", strategy="tumbled"))


@query("SELECT CASE event_type WHEN 'click' THEN 'R' ELSE 'S' END AS side, CASE event_type WHEN 'click' THEN event_id ELSE -1 END AS first_id, CASE event_type WHEN 'view' THEN event_id ELSE -1 END AS second_id FROM events WHERE event_type IN ('click', 'view')")
def union_both(spark, sf_dir):
    return union_streams(*clicks_and_views(spark, sf_dir)).select("side", F.coalesce("first.event_id", F.lit(-1)).alias("first_id"), F.coalesce("second.event_id", F.lit(-1)).alias("second_id"))


@query("SELECT CASE event_type WHEN 'click' THEN 'R' ELSE 'S' END AS side, count(*) AS rows_in, true AS stamped FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def ingest_stamp(spark, sf_dir):
    """Every row is stamped when it is taken in, not before it happened."""
    rows = union_streams(*clicks_and_views(spark, sf_dir), ingest="ingest_ts")
    happened = F.coalesce("first.ts", "second.ts").cast("timestamp")
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("rows_in"), F.bool_and(F.coalesce(F.col("ingest_ts") >= happened, F.lit(False))).alias("stamped"))


@query(f"WITH {EVENTS} SELECT {EVENT_PAIR} {theta(1, 1, '6 HOURS', '6 HOURS')}")
def stream_band_window_join(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    r, s = (file_stream(spark, f"{sf_dir}/event[s].parquet", schema).filter(F.col("event_type") == x) for x in ("click", "view"))
    joined = event_pairs(stream_join(r, s, r_key="value", s_key="value", surpass=1, behind=1, r_time="ts", s_time="ts", r_window="6 HOURS", s_window="6 HOURS"))
    at = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    run_to_end(parquet_sink(joined, f"{at}/rows", f"{at}/checkpoint"))
    return spark.read.schema(joined.schema).parquet(f"{at}/rows")


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster shares; only where none is named, as in tests, a local one."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='rangeweave-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


# ---------------------------------------------------------------- bins, loads and routing

BIN = f"CASE WHEN day BETWEEN 1 AND 2281 THEN least(CAST(trunc((day - 1.0) / CAST({WIDTH} AS DOUBLE)) AS INTEGER), {BINS - 1}) ELSE -1 END"
LOADS = f"""{SIDES},
counted AS (SELECT {BIN} AS bin FROM r WHERE day BETWEEN 1 AND 2281 UNION ALL SELECT {BIN} AS bin FROM s WHERE day BETWEEN 1 AND 2281),
load AS (SELECT bin, CAST(count(*) AS DOUBLE) AS load FROM counted GROUP BY bin),
dense AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(load, 0.0) AS load FROM range({BINS}) t(i) LEFT JOIN load ON bin = i)"""
ROUTE = f"route AS (SELECT CAST(i AS INTEGER) AS bin, CAST(ntile({PARTITIONS}) OVER (ORDER BY i) - 1 AS INTEGER) AS partition FROM range({BINS}) t(i))"


def route(spark: SparkSession) -> DataFrame:
    return routing.initial_route(spark, BINS, PARTITIONS)


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = [x.filter(keys.in_domain(F.col("day"))) for x in sides(spark, sf_dir)]
    return balance.bin_load(inside, keys.key_bin(F.col("day")), BINS)


def dense_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.dense(load(spark, sf_dir), BINS)


@query(f"SELECT l_orderkey, l_linenumber, {BIN} AS bin FROM (SELECT *, {DAY} AS day FROM lineitem)")
def key_bin(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", keys.key_bin(F.col("day")).alias("bin"))


@query(f"WITH {LOADS} SELECT bin, load FROM load")
def bin_load(spark, sf_dir):
    return load(spark, sf_dir)


@query(f"WITH {LOADS} SELECT bin, load FROM dense")
def bin_load_dense(spark, sf_dir):
    return dense_load(spark, sf_dir)


@query(f"WITH {LOADS} SELECT bin, load FROM load")
def load_string_parse(spark, sf_dir):
    text = balance.format_load(load(spark, sf_dir))
    return text.select(F.explode(balance.parse_load(F.col("load"))).alias("x")).select("x.bin", "x.load")


@query(f"WITH {ROUTE} SELECT bin, partition FROM route")
def route_init(spark, sf_dir):
    return route(spark)


@query(f"WITH {ROUTE} SELECT partition, count(*) AS bins FROM route GROUP BY partition")
def route_bin_counts(spark, sf_dir):
    return routing.bin_counts(route(spark), PARTITIONS)


GAPS = """runs AS (SELECT partition, bin, lag(bin) OVER (PARTITION BY partition ORDER BY bin) AS before FROM {0}),
ranges AS (SELECT partition, coalesce(min(bin) FILTER (bin > before + 1), min(bin)) AS left_bin, coalesce(min(before) FILTER (bin > before + 1), max(bin)) AS right_bin FROM runs GROUP BY partition)"""
GREEDY = f"""
start AS (SELECT partition AS first, left_bin FROM ranges ORDER BY partition LIMIT 1),
ring AS (SELECT row_number() OVER (ORDER BY CASE WHEN bin >= left_bin THEN 0 ELSE 1 END, bin) AS i, bin, load, first, (SELECT sum(load) / {PARTITIONS} FROM dense) AS average FROM dense, start),
walk AS (
    SELECT i, bin, first AS partition, load AS acc, load >= average AS full FROM ring WHERE i = 1
    UNION ALL
    SELECT ring.i, ring.bin, CASE WHEN walk.full THEN (walk.partition + 1) % {PARTITIONS} ELSE walk.partition END,
        CASE WHEN walk.full THEN 0 ELSE walk.acc END + ring.load,
        CASE WHEN walk.full THEN 0 ELSE walk.acc END + ring.load >= ring.average
    FROM walk JOIN ring ON ring.i = walk.i + 1),
moved AS (SELECT bin, CAST(partition AS INTEGER) AS partition FROM walk)"""
BASE = f"{LOADS}, {ROUTE}, {GAPS.format('route')}, {GREEDY}"


def new_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.rebalanced(dense_load(spark, sf_dir), route(spark), PARTITIONS)


@query(f"WITH RECURSIVE {BASE}, {GAPS.format('moved').replace('runs', 'runs2').replace('ranges', 'ranges2')} SELECT partition, left_bin, right_bin FROM ranges2")
def route_ranges(spark, sf_dir):
    return routing.ranges(new_route(spark, sf_dir))


SHIFTED, SHIFTS = 3, 20


@query(f"WITH {ROUTE} SELECT bin, CASE WHEN partition = {SHIFTED} AND n <= {SHIFTS} THEN {SHIFTED - 1} ELSE partition END AS partition FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY bin) AS n FROM route)")
def route_shift_forward(spark, sf_dir):
    return routing.shift(route(spark), SHIFTED, SHIFTS, PARTITIONS)


@query(f"WITH {ROUTE} SELECT bin, CASE WHEN partition = {SHIFTED} AND n <= {SHIFTS} THEN {SHIFTED + 1} ELSE partition END AS partition FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY bin DESC) AS n FROM route)")
def route_shift_backward(spark, sf_dir):
    return routing.shift(route(spark), SHIFTED, SHIFTS, PARTITIONS, forward=False)


# a table opened at 1000 ms, replaced between the watermarks 60000 and 61000
OPENED, MIN_WM, MAX_WM, WINDOW_MS = 1_000, 60_000, 61_000, 10_000
HISTORY = f"""history AS (SELECT coalesce(a.bin, b.bin) AS bin, coalesce(a.partition, b.partition) AS partition,
    CASE WHEN a.bin IS NOT NULL THEN {OPENED} ELSE {MIN_WM} END AS min_ts, CASE WHEN b.bin IS NOT NULL THEN {routing.FOREVER} ELSE {MAX_WM + routing.CLOSING_DELAY_MS} END AS max_ts
    FROM route a FULL JOIN moved b ON a.bin = b.bin AND a.partition = b.partition)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.advance(routing.opened(route(spark), OPENED), new_route(spark, sf_dir), MIN_WM, MAX_WM)


@query(f"WITH RECURSIVE {BASE}, {HISTORY} SELECT bin, partition, CAST(min_ts AS BIGINT) AS min_ts, CAST(max_ts AS BIGINT) AS max_ts FROM history")
def route_history(spark, sf_dir):
    return history(spark, sf_dir)


@query(f"WITH RECURSIVE {BASE}, {HISTORY} SELECT bin, partition, CAST(min_ts AS BIGINT) AS min_ts, CAST(max_ts AS BIGINT) AS max_ts FROM history WHERE max_ts >= 72000 - {WINDOW_MS}")
def route_expire(spark, sf_dir):
    return routing.expire(history(spark, sf_dir), 72_000, WINDOW_MS)


REACH = f"greatest(0, least({BINS - 1}, CAST(trunc(({{0}}) / CAST({WIDTH} AS DOUBLE)) AS INTEGER)))"
FAN = f"""probes AS (SELECT CAST(i AS INTEGER) AS bin, {REACH.format(f'i * CAST({WIDTH} AS DOUBLE) - 10.0')} AS lo, {REACH.format(f'(i + 1) * CAST({WIDTH} AS DOUBLE) + 10.0')} AS hi FROM range({BINS}) t(i)),
fan AS (SELECT p.bin, h.partition, min(h.min_ts) AS min_ts, max(h.max_ts) AS max_ts FROM probes p JOIN history h ON h.bin BETWEEN p.lo AND p.hi GROUP BY p.bin, h.partition)"""


def fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.fan_out(history(spark, sf_dir), BINS, WIDTH, 10.0, 10.0)


@query(f"WITH RECURSIVE {BASE}, {HISTORY}, {FAN} SELECT bin, partition, CAST(min_ts AS BIGINT) AS min_ts, CAST(max_ts AS BIGINT) AS max_ts FROM fan")
def probe_fanout(spark, sf_dir):
    return fan(spark, sf_dir)


@query(f"""WITH RECURSIVE {BASE}, {HISTORY}, {FAN}, q AS (SELECT CAST(i % {BINS} AS INTEGER) AS bin, CAST(60000 + i * 10 AS BIGINT) AS at_ms FROM range(2560) t(i))
SELECT q.bin, q.at_ms, partition, CAST(greatest(min_ts, at_ms - {WINDOW_MS}) AS BIGINT) AS min_ts, CAST(max_ts AS BIGINT) AS max_ts FROM q JOIN fan USING (bin) WHERE max_ts >= at_ms - {WINDOW_MS}""")
def probe_fanout_time(spark, sf_dir):
    probes = spark.range(2560).select((F.col("id") % BINS).cast("int").alias("bin"), (F.lit(60_000) + F.col("id") * 10).alias("at_ms"))
    return routing.fan_out_at(fan(spark, sf_dir), probes, "at_ms", WINDOW_MS).select("bin", "at_ms", "partition", "min_ts", "max_ts")


@query(f"""WITH RECURSIVE {BASE}, {HISTORY}, {FAN}, rows_in AS (SELECT {BIN} AS bin FROM r WHERE day BETWEEN 1 AND 2281)
SELECT CASE WHEN fan.partition = moved.partition THEN 'store' ELSE 'probe' END AS mode, count(*) AS copies, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM rows_in) AS per_row
FROM rows_in JOIN fan USING (bin) JOIN moved USING (bin) GROUP BY 1""")
def replication_factor(spark, sf_dir):
    rows = sides(spark, sf_dir)[0].filter(keys.in_domain(F.col("day"))).select(keys.key_bin(F.col("day")).alias("bin"))
    copies = routing.replicated(rows, fan(spark, sf_dir), new_route(spark, sf_dir)).groupBy("mode").agg(F.count(F.lit(1)).alias("copies"))
    return copies.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))).select("mode", "copies", (F.col("copies").cast("double") / F.col("n")).alias("per_row"))


PARTITION_LOAD = "SELECT partition, sum(load) AS load FROM {0} JOIN dense USING (bin) GROUP BY partition"


@query(f"WITH RECURSIVE {BASE} SELECT p.partition, p.load, left_bin, right_bin FROM ({PARTITION_LOAD.format('route')}) p JOIN ranges USING (partition)")
def partition_load(spark, sf_dir):
    return balance.partition_load(dense_load(spark, sf_dir), route(spark), PARTITIONS)


@query(f"WITH RECURSIVE {BASE}, p AS ({PARTITION_LOAD.format('route')}) SELECT avg(load) AS average, round(abs(max(load) - avg(load)) / avg(load), 9) AS factor, abs(max(load) - avg(load)) / avg(load) > 0.2 AS unbalanced FROM p")
def imbalance_factor(spark, sf_dir):
    loads = balance.partition_load(dense_load(spark, sf_dir), route(spark), PARTITIONS)
    return balance.imbalance(loads).select("average", F.round("factor", 9).alias("factor"), "unbalanced")


@query(f"""WITH {SIDES}, a AS (SELECT {BIN} AS bin, CAST(count(*) AS DOUBLE) AS load FROM r WHERE day BETWEEN 1 AND 2281 GROUP BY 1),
b AS (SELECT {BIN} AS bin, CAST(count(*) AS DOUBLE) AS load FROM s WHERE day BETWEEN 1 AND 2281 GROUP BY 1),
both_ AS (SELECT coalesce(a.load, 0.0) AS x, coalesce(b.load, 0.0) AS y FROM a FULL JOIN b ON a.bin = b.bin)
SELECT sum(abs(x - y)) AS moved, sum(x) AS total, sum(abs(x - y)) / sum(x) > 0.2 AS drifted FROM both_""")
def load_drift(spark, sf_dir):
    last, new = (balance.bin_load([x.filter(keys.in_domain(F.col("day")))], keys.key_bin(F.col("day")), BINS) for x in sides(spark, sf_dir))
    return balance.drift(last, new)


@query(f"WITH RECURSIVE {BASE} SELECT bin, partition FROM moved")
def rebalance_greedy(spark, sf_dir):
    return new_route(spark, sf_dir)


@query(f"WITH RECURSIVE {BASE} SELECT CAST(i AS INTEGER) AS partition, coalesce(p.load, 0.0) AS load FROM range({PARTITIONS}) t(i) LEFT JOIN ({PARTITION_LOAD.format('moved')}) p ON p.partition = i")
def rebalanced_partition_load(spark, sf_dir):
    return balance.partition_load(dense_load(spark, sf_dir), new_route(spark, sf_dir), PARTITIONS).select("partition", "load")


@query(f"""WITH RECURSIVE {BASE}, p AS ({PARTITION_LOAD.format('route')}), decided AS (SELECT sum(load) > 0 AND abs(max(load) - avg(load)) / avg(load) > 0.2 AS yes FROM p)
SELECT bin, partition, true AS moved FROM moved, decided WHERE yes UNION ALL SELECT bin, partition, false AS moved FROM route, decided WHERE NOT yes""")
def rebalance_decision(spark, sf_dir):
    """The route table in force after a first decision."""
    old = route(spark)
    new = balance.Balancer(BINS, PARTITIONS).decide(load(spark, sf_dir), old)
    return (old if new is None else new).select("bin", "partition", F.lit(new is not None).alias("moved"))


@query(f"""WITH {SIDES}, {ROUTE}, rows_in AS (SELECT {BIN} AS bin FROM l WHERE day BETWEEN 1 AND 2281)
SELECT partition, partition AS task, count(*) AS rows_in FROM rows_in JOIN route USING (bin) GROUP BY 1""")
def placed_rows(spark, sf_dir):
    """Each row in the task of its partition's number."""
    rows = lineitem(spark, sf_dir).filter(keys.in_domain(F.col("day"))).select(keys.key_bin(F.col("day")).alias("bin")).join(bounded_broadcast(route(spark)), "bin")
    placed = routing.placed(rows, "partition", PARTITIONS).withColumn("task", F.spark_partition_id())
    return placed.groupBy("partition", "task").agg(F.count(F.lit(1)).alias("rows_in"))


# ---------------------------------------------------------------- latency

LATENCY = f"""{EVENTS}, pairs AS (SELECT r.event_id AS r_id, s.event_id AS s_id, greatest(r.ts, s.ts) AS seen_at, epoch_us(greatest(r.ts, s.ts)) // 1000 - epoch_us(least(r.ts, s.ts)) // 1000 AS latency_ms {theta(1, 1, '6 HOURS', '6 HOURS')})"""


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the data's own clock: the later row arrives, the earlier one was taken in."""
    pairs = windowed(spark, sf_dir, 1, 1, "6 HOURS", "6 HOURS")
    now, since = F.greatest("r.ts", "s.ts"), F.least("r.ts", "s.ts")
    return pairs.select(F.col("r.event_id").alias("r_id"), F.col("s.event_id").alias("s_id"), now.alias("at"), metrics.latency_ms(now, since))


@query(f"WITH {LATENCY} SELECT r_id, s_id, latency_ms FROM pairs")
def pair_latency(spark, sf_dir):
    return latencies(spark, sf_dir).select("r_id", "s_id", "latency_ms")


@query(f"WITH {LATENCY} SELECT date_trunc('second', seen_at) AS window_start, CAST(s_id % 4 AS BIGINT) AS instance, count(*) AS results, round(avg(latency_ms), 6) AS average FROM pairs GROUP BY 1, 2")
def latency_per_second(spark, sf_dir):
    rows = latencies(spark, sf_dir).withColumn("instance", F.col("s_id") % 4)
    return metrics.latency_by_second(rows, "at", "latency_ms", "instance").select("window_start", "instance", "results", F.round("average", 6).alias("average"))


@query(f"""WITH {LATENCY}, calendar AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT max(ts) FROM events), INTERVAL 1 HOUR)) AS window_start)
SELECT c.window_start, CAST(coalesce(average, -1) AS BIGINT) AS average FROM calendar c LEFT JOIN (SELECT date_trunc('hour', seen_at) AS window_start, sum(latency_ms) // count(*) AS average FROM pairs GROUP BY 1) p USING (window_start)""")
def latency_window_avg(spark, sf_dir):
    span = table(spark, sf_dir, "events").agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("lo"), F.max("ts").alias("hi"))
    hours = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("window_start"))
    return metrics.latency_window_average(latencies(spark, sf_dir), "at", "latency_ms", "1 hour", hours)


# ---------------------------------------------------------------- Zipf, index

ZIPF_KEYS, ZIPF_SKEW = 1000, 0.2


@query(f"""WITH m AS (SELECT CAST(i AS INTEGER) AS key, pow(i, -{ZIPF_SKEW}) AS m FROM range(1, {ZIPF_KEYS + 1}) t(i))
SELECT key, round(m / (SELECT sum(m) FROM m), 9) AS probability, round(sum(m) OVER (ORDER BY key) / (SELECT sum(m) FROM m), 9) AS cdf FROM m""")
def zipf_cdf(spark, sf_dir):
    return zipf.zipf_cdf(spark, ZIPF_KEYS, ZIPF_SKEW).select("key", F.round("probability", 9).alias("probability"), F.round("cdf", 9).alias("cdf"))


@query(f"""WITH m AS (SELECT CAST(i AS INTEGER) AS key, pow(i, -{ZIPF_SKEW}) AS m FROM range(1, {ZIPF_KEYS + 1}) t(i)),
cdf AS (SELECT key, sum(m) OVER (ORDER BY key) / (SELECT sum(m) FROM m) AS cdf FROM m),
draws AS (SELECT CAST('0x' || substr(md5(i || ':0'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM range(100000) t(i))
SELECT key, count(*) AS n FROM draws ASOF JOIN cdf ON draws.u <= cdf.cdf GROUP BY key""")
def zipf_sample(spark, sf_dir):
    return zipf.zipf_sample(spark, 100_000, ZIPF_KEYS, ZIPF_SKEW).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id AS key, ts FROM events WHERE user_id BETWEEN 10 AND 150 AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def index_range_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return range_scan(rows, "key", 10, 150, "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query("SELECT user_id AS key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'purchase')) WHERE n = 1 AND user_id % 2 = 0")
def index_upsert_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "value", "event_type")
    now = upsert(rows.filter("event_type = 'signup'"), rows.filter("event_type = 'purchase'"), "key", F.col("event_id"))
    return now.filter(F.col("key") % 2 == 0).select("key", "event_id", "value")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "value", "event_type")
    return upsert(rows.filter("event_type = 'signup'"), rows.filter("event_type = 'purchase'"), "key", F.col("event_id")).select("key", "event_id", "value")


UPSERTED = "SELECT user_id AS key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END DESC, event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'purchase')) WHERE n = 1"


@query(UPSERTED)
def index_upsert(spark, sf_dir):
    """Every key of the index."""
    return upserted(spark, sf_dir)


LOOKED_UP = 7


@query(f"SELECT key, event_id, value FROM ({UPSERTED}) WHERE key = {LOOKED_UP}")
def index_lookup(spark, sf_dir):
    return lookup(upserted(spark, sf_dir), "key", LOOKED_UP)


# the names under which the blueprint lists them
for _new, _old in (("band_window_join", "band_window_join_binned"), ("union_streams", "union_both")):
    QUERIES[_new] = QUERIES.pop(_old)
    ORACLES[_new] = ORACLES.pop(_old)
