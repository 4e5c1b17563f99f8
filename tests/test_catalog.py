"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pulsegrid.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("events", "customer", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    got, want = (x[order].sort_values(order).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


@pytest.mark.parametrize("name", ["q13_auroc", "q40_beats"])
def test_to_the_last_decimal(spark, name):
    """Ranks depend on the last bit of a mean, and SDs of whole samples lie halfway between two decimals."""
    c = duckdb.connect()
    c.execute("SET threads = 1")  # with more, DuckDB adds up some windows in parts
    for table in ("events", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    got, want = catalog.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas(), c.execute(catalog.ORACLE_SQL[name]).df()
    got, want = (x[sorted(got.columns)].sort_values(got.columns[0]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
