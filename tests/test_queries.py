"""Every query with SQL against DuckDB, and the row counts that the blueprint gives."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from rangeweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COUNTS = {"tpch_band_join_shipdate": 886, "key_domain_filter": 473, "band_window_join": 14, "band_window_join_asym": 8, "equi_window_join": 189, "band_join_salted": 886}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) q").fetchall()
    rows = got.select(columns).collect()
    assert plain(rows) == plain(want)
    if name in COUNTS:
        assert len(rows) == COUNTS[name]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 886
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_key_of_the_index_is_lost(spark, duck):
    keys = {r[0] for r in duck.execute("SELECT DISTINCT user_id FROM events WHERE event_type IN ('signup', 'purchase')").fetchall()}
    assert sorted(r.key for r in QUERIES["index_upsert"](spark, SF).collect()) == sorted(keys) and any(k % 2 for k in keys)
    assert [r.key for r in QUERIES["index_lookup"](spark, SF).collect()] == [7]
