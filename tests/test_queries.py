"""Every query that has SQL gives the SQL's rows; others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry._own()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in ORACLES:
        want = con.execute(ORACLES[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == columns
        assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
