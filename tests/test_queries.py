"""Every query with an SQL counterpart against DuckDB, at the smallest scale."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from strataline import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(found):
    return sorted(tuple("%.6f" % v if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = rows(df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        assert mine
        return
    other = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == columns
    assert mine == rows([r[names.index(c)] for c in columns] for r in other.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
