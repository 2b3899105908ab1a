"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as contract
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(name, spark, con):
    state, _, _, note = compare(name, spark, con, FOLDER)
    assert state in ("ok", "rows-only"), note


def test_entry(spark):
    got = contract.entry(spark)
    assert got.count() == 31 and got.where("abs(score) <= 2.5 OR ds IS NULL").count() == 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
