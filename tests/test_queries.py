"""Each registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from labelloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(rows, columns):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = plain([r.asDict() for r in df.collect()], columns)
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        assert rows == plain([dict(zip(found.columns, r)) for r in found.fetchall()], columns)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
