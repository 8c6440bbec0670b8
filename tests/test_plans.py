from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rangeweave.plans import balance, routing

LOADS = [1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 0, 0]
ROUTE = [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7]
BALANCED = [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 7, 0, 0]


def table(df):
    return [r.partition for r in df.orderBy("bin").collect()]


def route_of(spark, owners):
    return spark.createDataFrame(list(enumerate(owners)), "bin int, partition int")


@pytest.fixture
def load(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(LOADS)], "bin int, load double")


def test_initial_route_and_counts(spark):
    route = routing.initial_route(spark, 20, 8)
    assert table(route) == ROUTE
    assert [r.bins for r in routing.bin_counts(route, 9).orderBy("partition").collect()] == [3, 3, 3, 3, 2, 2, 2, 2, 0]


def test_ranges_wrap_round_the_ring(spark):
    got = {r.partition: (r.left_bin, r.right_bin) for r in routing.ranges(route_of(spark, BALANCED)).collect()}
    assert got[0] == (18, 2) and got[1] == (3, 4) and got[7] == (15, 17)
    assert routing.range_of(route_of(spark, [1] * 4), 1, 4).collect()[0][:] == (-1, -1)
    assert routing.range_of(route_of(spark, [1] * 4), 0, 4).count() == 0


def test_shift_follows_the_ring(spark):
    route = route_of(spark, BALANCED)
    assert table(routing.shift(route, 0, 3, 8)) == [7, *BALANCED[1:18], 7, 7]
    assert table(routing.shift(route, 0, 2, 8, forward=False)) == [0, 1, 1, *BALANCED[3:]]
    assert table(routing.shift(route, 3, 9, 8)) == [2 if p == 3 else p for p in BALANCED]


def test_golden_balance(spark, load):
    route = routing.initial_route(spark, 20, 8)
    loads = balance.partition_load(load, route, 8)
    assert [r.load for r in loads.orderBy("partition").collect()] == [4, 6, 6, 6, 4, 4, 2, 0]
    found = balance.imbalance(loads, 0.5).first()
    assert (found.average, found.factor, found.unbalanced) == (4.0, 0.5, False)
    assert balance.imbalance(loads).first().unbalanced
    new = balance.rebalanced(load, route, 8)
    assert table(new) == BALANCED
    assert {r.load for r in balance.partition_load(load, new, 8).collect()} == {4.0}


def test_no_load_is_balanced(spark, load):
    nothing = load.selectExpr("bin", "0D AS load")
    found = balance.imbalance(balance.partition_load(nothing, routing.initial_route(spark, 20, 8), 8)).first()
    assert not found.unbalanced and found.factor == 0


def test_drift(spark, load):
    assert balance.drift(None, load).first().drifted
    assert not balance.drift(load, load).first().drifted
    more = load.selectExpr("bin", "load * 1.25 AS load")
    assert balance.drift(load, more).first().drifted
    assert not balance.drift(load, more, 0.3).first().drifted


def test_load_text(spark, load):
    text = balance.format_load(load.filter("bin < 3"))
    assert text.first().load == "0 1.0;1 1.0;2 2.0;"
    parsed = spark.createDataFrame([("0 1.0;3 2.0;",), ("",), (None,)], "t string").select(balance.parse_load(F.col("t")).alias("x"))
    assert [None if r.x is None else [(y.bin, y.load) for y in r.x] for r in parsed.collect()] == [[(0, 1.0), (3, 2.0)], [], None]


def test_history(spark):
    first = routing.opened(route_of(spark, [0, 0, 1, 1]), 5)
    after = routing.advance(first, route_of(spark, [0, 1, 1, 0]), 100, 110)
    got = {(r.bin, r.partition): (r.min_ts, r.max_ts) for r in after.collect()}
    forever = routing.FOREVER
    assert got == {(0, 0): (5, forever), (1, 0): (5, 410), (1, 1): (100, forever), (2, 1): (5, forever), (3, 1): (5, 410), (3, 0): (100, forever)}
    assert routing.expire(after, 420, 10).count() == 6
    assert routing.expire(after, 421, 10).count() == 4


def test_fan_out_reaches_neighbours(spark):
    history = routing.opened(route_of(spark, [0, 0, 1, 1]), 5)
    fan = routing.fan_out(history, 4, 10.0, 10.0, 10.0)
    got = {}
    for r in fan.collect():
        got.setdefault(r.bin, set()).add(r.partition)
    assert got == {0: {0, 1}, 1: {0, 1}, 2: {0, 1}, 3: {1}}
    probes = spark.createDataFrame([(0, 50)], "bin int, at long")
    assert {r.min_ts for r in routing.fan_out_at(fan, probes, "at", 10).collect()} == {40}


def test_balancer_replaces_its_baseline(spark, load):
    route = routing.initial_route(spark, 20, 8)
    b = balance.Balancer(20, 8)
    assert table(b.decide(load, route)) == BALANCED
    assert b.decide(load, route) is None
    assert balance.Balancer(20, 8, enabled=False).decide(load, route) is None
