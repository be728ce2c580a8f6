"""Every core query against its SQL in DuckDB, on whole tables."""

import glob
import math
import os

import duckdb
import pytest

from lexmill.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        return repr(round(float(x), 6)) if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


def connect(d):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_as_sql(spark, small, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(connect(small).execute(SQL[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
