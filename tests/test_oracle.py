"""Every registered query vs its DuckDB oracle at sf0.001 (the driver's gate
runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert len(df.columns) > 0
        return
    res = con.execute(SQL[name])
    msg = compare(rows, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert msg is None, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["item_id", "context"] and df.count() > 0
