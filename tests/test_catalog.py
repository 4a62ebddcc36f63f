import duckdb
import pytest

from meridia.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    cols = sorted(got.columns)
    rows = lambda f: sorted(map(tuple, f[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
    assert len(got)
