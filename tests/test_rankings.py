"""Whole rankings in blocks against plain arithmetic, and queries that must not make a row of every pair."""

import math
import re

import pytest

from sparkloom.operators import analysis, rankings
from sparkloom.plans import queries as plans
from tests.test_queries import rows

VECTORS = [(i, [((i * 7) % 5) / 4, ((i * 3) % 4) / 3], i % 3, i % 4) for i in range(120)]
VECTORS += [(120, None, 0, 1), (121, [1.0], 0, 1), (122, [None, 1.0], 1, 1), (123, [], 2, 1)]


def brute(depth, threshold=0.25):
    """Ranks by (score down, id as text), and the first document of the query's label that has a grade."""
    out = set()
    for q, qv, label, _ in VECTORS[::10]:
        if not qv or None in qv:
            continue
        hits = [(-math.floor(sum(a * b for a, b in zip(qv, v, strict=True)) * 1e9 + 0.5) / 1e9, str(i), i, lab == label and grade > 0) for i, v, lab, grade in VECTORS if i != q and v and None not in v and len(v) == len(qv)]
        hits = sorted(h for h in hits if -h[0] > threshold)
        first = next((r for r, h in enumerate(hits, 1) if h[3]), 0)
        out |= {(q, h[2], r, -h[0], h[3]) for r, h in enumerate(hits, 1) if r <= depth or r == first}
    return out


@pytest.fixture
def both(spark):
    v = spark.createDataFrame(VECTORS, "doc_id long, vector array<double>, label int, grade int")
    return v.where("doc_id % 10 = 0").selectExpr("doc_id as query_id", "vector", "label"), v


@pytest.mark.parametrize("depth", [1, 7, 1000])
def test_runs_like_plain_arithmetic(both, depth):
    got = rankings.runs(*both, [rankings.Side("vector", 0.25)], depth).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"], r["score"], r["grade"] is not None) for r in got} == brute(depth)
    assert len(got) == len(brute(depth))


def test_rounding_is_that_of_sums_in_order():
    import numpy as np

    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(7, 64)).astype(np.float32).astype(np.float64), rng.normal(size=(5000, 64)).astype(np.float32)
    for digits in (6, 9):
        want = rankings._half_away(rankings._in_order(q[:, None, :], v.astype(np.float64)[None]) * 10.0**digits)
        assert (rankings.scaled(q, v, digits) == want).all()
    v[0, 0], v[1, 0], q[0, 0] = np.inf, np.nan, 1.0
    assert np.isinf(rankings.scaled(q, v, 9)[0, 0]) and np.isnan(rankings.scaled(q, v, 9)[0, 1])


IN_BLOCKS = ["distinct_run", "first_relevant", "rerank_keeps_tail", "overlap_at_k", "rrf_weighted_sweep", "rank_buckets", "packed_ranks", "dense_maxpool", "metric_summary", "rrf_hybrid", "linear_fusion", "eval_ndcg_exp", "error_rows", "rank_changes", "oracle_ceiling", "hard_negatives", "ranking_checks", "gate_sweep", "gated_rerank", "stable_rank", "dense_prf"]


@pytest.mark.parametrize("name", IN_BLOCKS)
def test_no_row_of_every_pair(spark, data, name):
    plan = plans.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "Cartesian" not in plan  # an inner product as an expression over rows of pairs


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """Runs of more than 1,000 documents, where each query has one relevant document, first in one run and far down in the other."""
    import numpy as np

    at, rng = tmp_path_factory.mktemp("deep"), np.random.default_rng(3)
    v = (np.abs(rng.normal(size=(2600, 5))) + 0.2).astype(np.float32)
    v[1::50, 3:] = 100 * v[::50, 3:] / np.linalg.norm(v[::50, 3:], axis=1, keepdims=True)  # first in one run
    v[1::50, :3] = 0.01  # and last in the other
    rows = [(i, [float(x) for x in v[i]], i // 50 if i % 50 < 2 else None) for i in range(2600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def duck(at, sql, *tables):
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return con.execute(sql).df()


def test_three_runs_are_whole(spark, deep):
    got = analysis.ranks_of(*plans._three_runs(spark, deep)).toPandas()
    assert rows(got) == rows(duck(deep, plans.RANKS + "SELECT query_id, nullif(a, 1 << 30) AS a, nullif(b, 1 << 30) AS b, nullif(f, 1 << 30) AS f FROM rk", "embeddings"))
    assert len(got) > 40 and got["b"].max() > 1000


@pytest.mark.parametrize("name", ["lost_by_fusion"])
def test_like_duckdb_beyond_a_thousand(spark, deep, name):
    want = duck(deep, plans.SQL[name], "embeddings")
    assert rows(plans.QUERIES[name](spark, deep).toPandas()) == rows(want) and len(want)


def test_a_whole_ranking_keeps_the_candidates_of_both_runs(spark):
    from sparkloom.operators import fusion
    from sparkloom.settings import Settings

    chunks = spark.createDataFrame([(i, f"n{i}", "function", False) for i in range(6)], "doc_id long, qualified_name string, kind string, is_test boolean")
    run = lambda ids: spark.createDataFrame([(0, i, 1.0 / (i + 1)) for i in ids], "query_id long, doc_id long, score double")
    ranked = lambda **more: fusion.rank(spark.createDataFrame([(0, "find it")], "query_id long, query string"), chunks, run([0, 1]), run([2, 3, 4]), "hybrid", settings=Settings(candidates=2), **more)
    assert {r["doc_id"] for r in ranked(whole=True).collect()} == {0, 1, 2, 3}
    assert ranked().count() == 2


def test_sums_of_a_document_need_no_shuffle(spark):
    from sparkloom.operators import lexical

    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma") for i in range(20)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "alpha beta1"), (1, "gamma")], "query_id long, query string")
    found = lexical.grid(lexical.build(docs), queries, [(1.2, 0.5), (1.6, 0.75)])
    assert found.count() == 80
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", found._jdf.queryExecution().executedPlan().toString())
