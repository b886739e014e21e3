"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from compare import compare, connect
from haulage.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SF, name, QUERIES[name], ORACLE_SQL.get(name)) is None


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == [
        "chunk_id", "rows", "first_key", "last_key", "total_cents",
    ]
