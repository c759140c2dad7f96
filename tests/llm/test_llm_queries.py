"""Registered queries on the smallest test set: their SQL where there is one, no pairwise plan."""

import os

import pytest

from check import compare, connection
from supportgraph.llm.oracle import ORACLE
from supportgraph.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    ok, note = compare(spark, con, name, SF_DIR, df)
    assert ok, note
    assert "types" not in note


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == [*range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)
