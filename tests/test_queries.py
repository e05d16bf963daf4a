"""Every registered query runs; those with SQL return what DuckDB returns."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
CORE = {k: v for k, v in entry.queries().items() if k != "pipeline" and not (k.startswith("op") and k[2:3].isdigit())}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, db, name):
    got = CORE[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
