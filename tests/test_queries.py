"""Registered queries on the smallest test set: same result as their SQL, and no pairwise plan."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connection
from workloads.oracle import ORACLE
from workloads.queries import QUERIES

# Fitted by k-means, which SQL cannot repeat: see test_ivf.
TRAINED = {"ivf_topk_hits", "ivf_recall"}
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    ok, note = compare(spark, con, name, SF_DIR, df)
    assert ok, note
    assert "types" not in note


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLE) == TRAINED


def test_entry(spark):
    assert entry(spark).columns[:2] == ["query_id", "ticketId"]
