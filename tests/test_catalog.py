"""Every query with SQL gives the SQL's rows; the others run and keep their columns."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from lumenlog.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0
