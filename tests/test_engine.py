"""The engine over several versions: incremental indexing, vectors, maps, comparison, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.__main__ import run
from sparkloom.engine import Engine
from sparkloom.operators import analysis, graph, investigate, versions
from sparkloom.operators.dense import hashing_encoder
from sparkloom.sources import corpora, store

FILES = {
    "a.js": 'import { save } from "./b.js";\nexport function main() { save(1); }\n',
    "b.js": "export function save(x) { return check(x); }\nfunction check(x) { return x; }\n",
    "lib/c.js": "export function lonely() { return 1; }\n",
}


def write(repo, files):
    for p, text in files.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(text)


def test_versions_vectors_and_comparison(spark, tmp_path):
    repo, folder = tmp_path / "repo", f"file://{tmp_path}/store"
    write(repo, FILES)
    calls = []

    def encoder(texts):
        calls.append(len(texts))
        return hashing_encoder()(texts)

    e = Engine(spark, folder, encoder=encoder, model="h")
    first = e.index(str(repo))
    assert (first["mode"], first["files"], e.index(str(repo))["mode"]) == ("full", 3, "noop")
    assert not e.changed(str(repo))
    write(repo, {"b.js": FILES["b.js"].replace("return x;", "return x + 1;") + "export function extra() { check(2); }\n"})
    assert e.changed(str(repo))
    second = e.index(str(repo))
    assert (second["mode"], second["reused_files"]) == ("incremental", 2) and second["version_key"] != first["version_key"]
    again = Engine(spark, folder, encoder=encoder, model="h")  # names survive the engine
    again.repo = str(repo)
    assert again.key() == second["version_key"] and again.status()["semantic"] and again.versions().count() == 1
    assert {r["doc_id"] for r in again.tables()["vectors"].collect()} == {"a.js::main", "b.js::save", "b.js::check", "b.js::extra", "lib/c.js::lonely"}
    found = again.search("where is lonely", top_k=3)
    assert found["results"][0]["symbol_name"] == "lonely" and found["results"][0]["evidence"]["semantic_rank"] is not None and found["version_key"] == second["version_key"]
    t = again.trace("main", "check")
    assert t["status"] == "SUPPORTED" and [n["symbol_id"] for n in t["nodes"]] == ["a.js::main", "b.js::check", "b.js::save"] and len(t["edges"]) == 2
    nodes, edges = again.map(symbol="b.js::check")
    assert {r["symbol_id"] for r in nodes.collect()} == {"b.js::check", "b.js::save", "b.js::extra"} and edges.count() == 2
    assert {r["symbol_id"] for r in again.map(file="b.js")[0].collect()} == {"b.js::save", "b.js::check", "b.js::extra"}
    x, y = again.tables(first["version_key"]), again.tables()
    symbols, calls_ = versions.symbol_changes(x["symbols"], y["symbols"]), versions.edge_changes(x["edges"], y["edges"], ["src", "dst", "edge_type", "expression"])
    assert {(r["symbol_id"], r["change"]) for r in symbols.collect()} == {("b.js::check", "modified"), ("b.js::extra", "added")}
    near = versions.relevant_changes(symbols, calls_, spark.createDataFrame([("b.js::extra",)], "symbol_id string"))
    assert [r["symbol_id"] for r in near[0].collect()] == ["b.js::extra"] and [(r["src"], r["change"]) for r in near[1].collect()] == [("b.js::extra", "added")]
    with pytest.raises(ValueError):
        again.tables("nothing")
    tables = again.tables()
    bad = tables["symbols"].where("symbol_id = 'b.js::save'").withColumn("start_line", F.col("start_line") + 7)
    assert {r["problem"] for r in investigate.invalid_graph(bad, tables["edges"], tables["symbols"], tables["edges"], tables["files"]).collect()} == {"node", "edge"}
    assert json.loads(run(spark, [folder, "--repo", str(repo), "source", "lib/c.js", "1", "1"])) == ["export function lonely() { return 1; }"]


def test_a_failed_version_is_not_seen_and_can_be_tried_again(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    good = spark.createDataFrame([("x", [1.0, 0.0])], "doc_id string, vector array<float>")
    broken = good.withColumn("vector", F.raise_error(F.lit("no")).cast("array<float>"))
    with pytest.raises(Exception, match="no"):
        store.save_index({"chunks": good.select("doc_id"), "vectors": broken}, folder, "k" * 24, {})
    assert not store.stored(spark, folder, "k" * 24)
    store.save_index({"chunks": good.select("doc_id"), "vectors": good}, folder, "k" * 24, {"a": 1})
    assert store.load_index(spark, folder, "k" * 24)[1] == {"a": 1}
    with pytest.raises(FileExistsError):
        store.save_index({"chunks": good}, folder, "k" * 24, {})
    odd = spark.createDataFrame([("x", [1.0, float("nan")])], "doc_id string, vector array<float>")
    store.save_index({"chunks": good.select("doc_id"), "vectors": odd}, folder, "l" * 24, {})
    with pytest.raises(ValueError):
        store.load_index(spark, folder, "l" * 24)


def test_published_vectors_are_taken_only_if_they_agree(spark):
    enc = hashing_encoder(8)
    texts = [f"text number {i} of many" for i in range(300)]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "text_hash string, text string")
    nothing = spark.createDataFrame([], "model string, text_hash string, vector array<float>")
    right = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(enc(texts))], "text_hash string, vector array<float>")
    wrong = right.withColumn("vector", F.transform("vector", lambda x: -x))
    assert store.published(chunks, nothing, right, "m", enc).count() == 300
    assert store.published(chunks, nothing, wrong, "m", enc).count() == 0
    assert store.published(chunks.limit(200), nothing, right, "m", enc).count() == 0


def test_graph_views(spark):
    nodes = spark.createDataFrame([(f"s{i}", f"Name{i}", f"f{i % 2}.js", i) for i in range(6)], "symbol_id string, qualified_name string, file_path string, start_line int").withColumns({"kind": F.lit("function"), "end_line": F.col("start_line")})
    edges = spark.createDataFrame([("s5", "s3"), ("s0", "s1")], "src string, dst string")
    shown, inside = graph.view(nodes, edges, "name", "s5", most=3)
    assert [r["symbol_id"] for r in shown.collect()] == ["s5", "s3", "s0"] and [tuple(r) for r in inside.collect()] == [("s5", "s3")]
    assert [r["symbol_id"] for r in graph.view(nodes, edges, "F1.JS")[0].collect()] == ["s1", "s3", "s5"]
    assert {r["symbol_id"] for r in graph.symbol_map(nodes, edges, "f0.js", 2)[0].collect()} == {"s0", "s2"}
    paths = spark.createDataFrame([("src/a.js",), ("src/lib/b.js",), ("src/lib/c.js",), ("top.js",)], "path string")
    assert [tuple(r) for r in graph.tree(paths).collect()] == [("src", True), ("top.js", False)]
    assert [tuple(r) for r in graph.tree(paths, "src/").collect()] == [("lib", True), ("a.js", False)]
    near, status = graph.neighbourhood(edges, nodes.select(F.col("symbol_id").alias("id")), 1, 1)
    assert {(r["start"], r["status"]) for r in status.collect()} == {("s5", "SEARCH_LIMIT_REACHED"), ("s3", "SEARCH_LIMIT_REACHED"), ("s0", "SEARCH_LIMIT_REACHED"), ("s1", "SEARCH_LIMIT_REACHED"), ("s2", "OK"), ("s4", "OK")}


def test_choice_of_a_gate_and_small_helpers(spark, tmp_path):
    # the new rank helps where the margin is small and harms where it is large
    rows = [(i, "m", i / 10, 5 if i < 6 else 1, 1 if i < 6 else 5) for i in range(12)]
    rows = spark.createDataFrame(rows, "query_id int, measure string, margin double, old_rank int, new_rank int")
    sweep = analysis.gate_sweep(rows, analysis.gate_thresholds(rows, (10, 50, 90)))
    best = analysis.choose_gate(sweep).first()
    assert (best["quantile"], best["gated"], best["gains_kept"], best["harms_avoided"], best["ndcg"]) == (50.0, 6, 6, 6, 1.0)
    assert analysis.choose_gate(sweep.where("quantile = 90")).count() == 0
    one = lambda c: spark.range(1).select(c).first()[0]
    told = lambda p, c, g: one(analysis.bottleneck(F.lit(p), F.lit(c), F.lit(g)))
    assert [told(1, 0.9, 0.9), told(0, 0.1, 0.9), told(0, 0.9, 0.05), told(0, 0.9, 0.0)] == ["MEASUREMENT", "CANDIDATE RETRIEVAL", "FUSION", "RANKING"]
    assert one(analysis.stratum(F.lit("x\nclass Solution:\n"))) == "starter" and one(analysis.stratum(F.lit("input()"))) == "stdin"
    texts = spark.createDataFrame([(i, "x" * (i * 37 % 50)) for i in range(100)], "doc_id int, text string")
    sizes = [len(r["text"]) for r in analysis.by_length(texts, parts=2).collect()]
    assert sizes == sorted(sizes)
    run_ = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    packed = corpora.pack_ranks(run_)
    assert corpora.check_packed(packed).count() == 0 and corpora.check_packed(packed.withColumn("docs", F.lit("b a"))).count() == 1
    v = spark.createDataFrame([(1, [1.0])], "doc_id long, vector array<float>")
    for n in ("s1", "s2"):
        v.write.parquet(f"{tmp_path}/{n}")
    assert corpora.vector_shards(spark, [f"{tmp_path}/s1"]).count() == 1
    with pytest.raises(Exception, match="two shards"):
        corpora.vector_shards(spark, [f"{tmp_path}/s1", f"{tmp_path}/s2"]).collect()


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string").orderBy("n")
    assert corpora.markdown(rows) == "| n | t |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        corpora.markdown(rows, 1)
    corpora.write_evidence(rows, f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/e").count() == 2


def test_snippets_of_several_versions(spark):
    rows = [("v1", 1, 7, "sort the list"), ("v2", 2, 7, "sort the list"), ("v2", 2, 8, "sort the list quickly"), ("v1", 1, 9, "nothing here")]
    snippets = spark.createDataFrame(rows, "version string, version_order int, doc_id long, text string")
    got = versions.snippet_search(spark.createDataFrame([(0, "sort list")], "query_id int, query string"), snippets).orderBy("rank").collect()
    assert [(r["id"], r["versions"], r["occurrences"], r["lines"]) for r in got] == [(7, ["v1", "v2"], ["v1:7", "v2:7"], 1), (8, ["v2"], ["v2:8"], 1)]


def test_many_queries_meet_documents_in_blocks(spark, monkeypatch):
    from sparkloom.operators import dense

    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "doc_id int, vector array<float>")
    q = v.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qvec"))
    want = sorted(map(tuple, dense.best_scores(q, v, 3).collect()))
    monkeypatch.setattr(dense, "QUERIES", 5)
    monkeypatch.setattr(dense, "BLOCK", 8)
    found = dense.best_scores(q, v, 3)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
