"""Every query against DuckDB, over the whole tables of the smallest size."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from larkspur import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def plain(rows):
    key = lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r]
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=key)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.queries()[name](spark, str(DATA))
    want = duck.sql(catalogue.oracle_sql()[name])
    assert frame.columns == want.columns
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert [types[t] for _, t in frame.dtypes] == [str(t) for t in want.types]
    assert plain(map(tuple, frame.collect())) == plain(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "o_totalprice"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
