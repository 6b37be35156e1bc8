"""Operators with a DuckDB counterpart, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from trustlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(con.sql(f"select {', '.join(columns)} from ({ORACLES[name]}) q").fetchall(), key=key)


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
