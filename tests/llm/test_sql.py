"""The operators that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from rangeweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) q").fetchall()
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(columns).collect()) == plain(want)
