"""Every registered query with an SQL twin, on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    status, detail, _ = compare(spark, con, name, queries()[name], oracle_sql()[name], SF_DIR)
    assert status == "ok", detail


def test_entry(spark):
    assert entry(spark).count() == 4


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
