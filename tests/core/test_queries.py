"""Every query with SQL against DuckDB over the smallest tables, whole."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tickloom.plans import catalogue  # noqa: E402

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, database, name):
    frame = catalogue.QUERIES[name](spark, TABLES)
    cursor = database.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(str([plain(dict(zip(columns, r))[c]) for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in frame.collect()) == want


def test_flagship(spark):
    rows = catalogue.flagship(spark, TABLES).collect()
    assert rows and all(r.VPIN is None or 0 <= r.VPIN <= 1 for r in rows)
