"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lexigauge import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels")


def rows(df):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(float(x)) if isinstance(x, float) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    expected = db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
