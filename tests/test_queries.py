"""Every registered query of the library against its DuckDB twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from ringdata.plans.catalog import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
            return "null"
        if isinstance(x, (bool, str)):
            return str(x)
        return f"{float(x):.5f}" if not hasattr(x, "isoformat") else str(x)

    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D).toPandas()
    assert len(got.columns) > 0
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0
