"""Every registered retrieval query against its SQL, on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from noteloom.plans import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    oracle.assert_same(q.QUERIES[name](spark, SF), q.ORACLES[name], duck)


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(q.QUERIES) == set(q.ORACLES)
    assert entry.entry(spark).columns == ["query_id", "rank", "name", "category", "score", "snippet"]


def test_scans_read_only_what_they_need(spark):
    plan = q.QUERIES["recency_snapshot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = q.QUERIES["content_hash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_hybrid_merge_searches_only_what_it_shows(spark, monkeypatch):
    asked, search = [], q.vectors.vector_search
    monkeypatch.setattr(q.vectors, "vector_search", lambda held, queries, *a, **b: asked.append(queries.count()) or search(held, queries, *a, **b))
    q.QUERIES["hybrid_merge"](spark, SF)
    assert asked == [3]
