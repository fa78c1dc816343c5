"""Every registered query of the library against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from swathlab.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return repr(round(value, 7) + 0.0)
    return value.isoformat()[:26] if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    found = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    places = [names.index(c) for c in order]
    assert found == sorted(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
