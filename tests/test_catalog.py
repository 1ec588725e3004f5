"""Every query of the catalogue against its DuckDB oracle."""

import duckdb
import pytest

from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("nation", "customer", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in catalog.ORACLES:
        found = db.execute(catalog.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
