"""Every registered query against its SQL, on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else str(v) if isinstance(v, pd.Timestamp) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if not isinstance(v, (bool, str)) else v for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(want), "the case is empty"
