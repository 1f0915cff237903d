import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomset import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _rows(df):
    clean = lambda v: None if pd.isna(v) else round(float(v), 3) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and v.dtype.kind in "iuf" else str(v)
    columns = sorted(df.columns)
    return columns, sorted((tuple(clean(v) for v in row) for row in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_as_sql(spark, duck, name):
    found, want = core.queries()[name](spark, DATA).toPandas(), duck.execute(core.oracle_sql()[name]).df()
    assert _rows(found.astype(object)) == _rows(want.astype(object))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
