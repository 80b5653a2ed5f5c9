"""Queries take all of their input."""

import pytest

from sparkloom.plans import queries as plans


@pytest.mark.parametrize("name", ["callers", "khop", "bounded_paths", "shortest_paths"])
def test_all_nodes(spark, data, name):
    nodes, adj = plans._graph(spark, data)
    whole = {r[0] for r in plans.QUERIES[name](spark, data).collect()}
    assert whole == ({r["dst"] for r in adj.collect()} if name == "callers" else {r["id"] for r in nodes.collect()})


def test_rank_changes_by_query(spark):
    from sparkloom.operators import versions

    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (1, "x", 1)], "query_id long, symbol_id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (1, "y", 1), (1, "x", 2)], "query_id long, symbol_id string, rank int")
    got = sorted(tuple(r) for r in versions.rank_changes(a, b, ["query_id"]).collect())
    assert got == [(0, "x", 1, None, None, 2), (0, "y", 2, 1, 1, 1), (1, "x", 1, 2, -1, 2), (1, "y", None, 1, None, 1)]


def test_all_queries_and_turns(spark, data):
    ids = {r["query_id"] for r in plans._vector_queries(spark, data).collect()}
    assert {r["query_id"] for r in plans.rank_changes(spark, data).collect()} == ids
    turns = plans.table(spark, data, "conversations")
    assert plans.operator_evidence(spark, data).count() == turns.count() - turns.select("conv_id").distinct().count()
