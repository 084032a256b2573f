"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from nearfield.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    a = ours[cols].sort_values(cols).reset_index(drop=True)
    b = theirs[cols].sort_values(cols).reset_index(drop=True)
    assert len(a) == len(b) > 0
    for c in cols:
        if a[c].dtype == object:
            assert (a[c] == b[c]).all()
        else:
            assert (abs(a[c].astype(float) - b[c].astype(float)) < 2e-6).all()
