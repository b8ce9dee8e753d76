"""Every registered query beside its SQL, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.filterwarnings("ignore:no hierarchy")
@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, contract.queries()[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["id", "balance", "nation", "segment"] and out.count() > 0
