"""Every query with a SQL check gives the same rows at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry_points
from citegrid.plans import catalogue
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

QUERIES, CHECKS = catalogue.QUERIES, catalogue.CHECKS


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_checks_belong_to_queries():
    assert set(QUERIES) <= set(entry_points.queries()) and set(CHECKS) <= set(entry_points.oracle_sql())
    assert set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) - set(CHECKS) == {"nodes_louvain", "nodes_leiden", "nodes_table"}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], CHECKS[name], SF_DIR)
    assert ok, message


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["source", "target", "weight", "type"]
    assert df.first()["weight"] >= 1
