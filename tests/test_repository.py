"""From source files to answers."""

import subprocess

import pytest

from sparkloom.engine import Engine
from sparkloom.functions.javascript import read
from sparkloom.operators import investigate, structure, versions

FILES = {
    "entry.js": 'import { startOrder } from "./controller.js";\nexport function main() { startOrder(1); }\n',
    "controller.js": 'import { OrderService } from "./service.js";\nexport function startOrder(x) { return placeOrder(x); }\nexport function placeOrder(x) { saveOrder(x); }\nfunction saveOrder(x) { return x; }\n',
    "service.js": "export class OrderService {\n  constructor() { this.repo = new Repo(); }\n  run(a) { this.check(a); this.repo.find(a); }\n  check(a) { return a; }\n}\nclass Repo {\n  find(a) { return a; }\n}\n",
    "lib/util.js": "function twice(x) { return x; }\nmodule.exports = { twice };\n",
    "use.js": 'const util = require("./lib/util");\nfunction go() { util.twice(2); external(); }\nfunction shadow(go) { go(); }\n',
    "config.js": "export const config = 1;\n",
    "bad.js": "function broken( { other(); \n",
}


@pytest.fixture
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, source string")


def test_reader_sees_names_and_scopes():
    f = read("a.test.js", "it('works', () => { run(); });\nclass A { static s() {} get g() { return 1; } m = () => { this.x(); }; }\nexports.f = function () {};\nlet r = /a[/]b/g, t = `x${`y`}`;\n")
    assert not f.has_errors
    assert [(s["name"], s["kind"], s["method_kind"]) for s in f.symbols] == [("test:works", "test", "normal"), ("A", "class", "normal"), ("s", "method", "static"), ("g", "method", "get"), ("m", "method", "field"), ("f", "function", "normal")]
    assert all(s["is_test"] for s in f.symbols) and f.exports["f"] == "a.test.js::f"
    assert read("b.js", "function (").has_errors
    f = read("d.js", "// far\n\n\n\n\n// of f\n/* too */\nexport function f() {}\nclass A {\n  // of m\n  m() { /* inside */ }\n}\nconst g = () => 1;\n")
    assert {s["name"]: s["comments"] for s in f.symbols} == {"f": ["// of f", "/* too */"], "A": [], "m": ["// of m"], "g": []}
    assert [s["kind"] for s in read("c.js", "var a = 1;\n" * 100).symbols] == ["module", "module"]


def test_calls_resolve_without_guessing(files):
    edges, left = structure.resolve_calls(structure.parse(files))
    got = {(r["src"].split("::")[1], r["dst"].split("::")[1], r["how"]) for r in edges.collect()}
    assert got == {
        ("main", "startOrder", "named_or_default_import"), ("startOrder", "placeOrder", "lexical_scope"), ("placeOrder", "saveOrder", "lexical_scope"),
        ("OrderService.run", "OrderService.check", "same_class_method"), ("OrderService.run", "Repo.find", "constructor_instance"), ("go", "twice", "commonjs_require"),
    }
    assert {(r["callee"], r["reason"]) for r in left.collect()} >= {("external", "UNRESOLVED"), ("go", "UNRESOLVED")}
    order = structure.sequences(edges).select("before", "after").collect()
    assert [(r["before"].split("::")[1], r["after"].split("::")[1]) for r in order] == [("OrderService.check", "Repo.find")]


def test_calls_that_must_stay_unresolved(spark):
    files = {
        "a.js": "class S {\n  constructor() { this.repo = new R(); }\n  run() { this.repo.find(); }\n  end() { delete this.repo; }\n}\nclass R { find() {} }\n",
        "b.js": "class S {\n  constructor() { this.repo = new R(); this[k] = 1; }\n  run() { this.repo.find(); this.run(); }\n}\nclass R { find() {} }\n",
        "c.js": 'import { f, g as h } from "./d";\nimport * as all from "./d.js";\nfunction go(f) { f(); }\nfunction two() { f(); h(); all.f(); const f2 = 1; f2(); }\nlet again = () => 1;\nagain = 2;\nfunction three() { again(); }\nfunction dup() {}\nfunction dup() {}\nfunction four() { dup(); }\n',
        "d.js": "export function f() {}\nexport function g() {}\n",
        "e.js": "function outer() { function inner() { helper(); obj.m(); } inner(); }\nfunction helper() {}\n",
        "sub/f.js": 'const { f } = require("../d");\nconst lib = require("./lib");\nfunction go() { f(); lib.run(); lib(); }\n',
        "sub/lib/index.js": "module.exports = main;\nfunction main() {}\nmain.run = 1;\nmodule.exports.run = run;\nfunction run() {}\n",
        "x.jsx": "function View() { return <p>don't stop {helper()} it's fine</p>; }\nfunction helper() {}\n",
    }
    parsed = structure.parse(spark.createDataFrame(list(files.items()), "path string, source string"))
    edges, left = structure.resolve_calls(parsed)
    got = {(r["src"], r["dst"].split("::")[1], r["how"]) for r in edges.collect()}
    assert got == {
        ("c.js::two", "f", "named_or_default_import"), ("e.js::outer", "outer.inner", "lexical_scope"), ("e.js::outer.inner", "helper", "lexical_scope_nested"),
        ("sub/f.js::go", "f", "commonjs_require"), ("sub/f.js::go", "run", "commonjs_require"), ("sub/f.js::go", "main", "commonjs_require"), ("x.jsx::View", "helper", "lexical_scope"),
    }
    assert {(r["call_file"], r["callee"], r["reason"]) for r in left.collect()} == {
        ("a.js", "this.repo.find", "UNRESOLVED"), ("b.js", "this.repo.find", "COMPUTED_WRITE"), ("b.js", "this.run", "UNRESOLVED"), ("c.js", "f", "UNRESOLVED"), ("c.js", "h", "UNRESOLVED"), ("c.js", "all.f", "UNRESOLVED"),
        ("c.js", "f2", "UNRESOLVED"), ("c.js", "again", "UNRESOLVED"), ("c.js", "dup", "UNRESOLVED"), ("e.js", "obj.m", "UNSUPPORTED_SCOPE"),
    }


def test_module_paths(spark):
    from pyspark.sql import functions as F

    rows = [("a/b.js", "./c"), ("a/b.js", "../c.js"), ("a/b.js", "c"), ("b.js", "../../x"), ("a/b/c.js", "./../d/./e"), ("b.js", "./c.json"), ("b.js", "./.c")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, m string").coalesce(1).select(structure.module_paths(F.col("p"), F.col("m"))).collect()]
    assert got == [["a/c.js", "a/c/index.js"], ["c.js"], [], ["../../x.js", "../../x/index.js"], ["a/d/e.js", "a/d/e/index.js"], [], [".c.js", ".c/index.js"]]


def test_premises_of_questions(spark):
    symbols = spark.createDataFrame([("f::a", "startOrder", "startOrder", "function", None), ("f::b", "saveOrder", "Store.saveOrder", "method", "f::S"), ("g::b", "twice", "twice", "function", None), ("h::b", "twice", "twice", "function", None)], "symbol_id string, name string, qualified_name string, kind string, parent_symbol_id string")
    edges = spark.createDataFrame([("f::a", "f::b", 3)], "src string, dst string, line int")
    asked = ["does startOrder call saveOrder", "why does saveOrder call startOrder?", "does twice call startOrder", "where is KafkaQueue defined?", "where is twice", "where is the order handling implemented?", "where is the queue implemented?", "how does Store.saveOrder work", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {r["query_id"]: r for r in investigate.ground(queries, symbols, edges).collect()}
    assert [got[i]["status"] for i in range(9)] == ["VERIFIED_CALL", "CALL_NOT_ESTABLISHED", "AMBIGUOUS_SYMBOL", "NO_VERIFIED_SYMBOL", "AMBIGUOUS_SYMBOL", "SOURCE_CANDIDATES", "NO_VERIFIED_IMPLEMENTATION", "NO_VERIFIED_SYMBOL", "SOURCE_CANDIDATES"]
    assert [tuple(e) for e in got[0]["call_edges"]] == [("f::a", "f::b", 3)] and got[4]["definitions"] == ["g::b", "h::b"]
    plans = {r["query_id"]: r["symbols"] for r in investigate.plan(queries, symbols).collect()}
    assert plans[0] == ["startOrder", "saveOrder"] and plans[7] == ["Store.saveOrder"] and plans[8] == []


def test_trace_statuses_and_components(spark):
    from sparkloom.operators import graph

    edges = [("a", "t"), ("t", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "y"), ("y", "x"), ("y", "z")]
    adj = spark.createDataFrame(edges, "src string, dst string")
    pairs = spark.createDataFrame([("a", "t"), ("a", "g"), ("a", "f"), ("x", "z"), ("z", "x"), ("a", "a")], "source string, target string")
    got = {(r["source"], r["target"]): r["status"] for r in graph.statuses(adj, pairs, 5).collect()}
    assert got == {("a", "t"): "SUPPORTED", ("a", "g"): "SEARCH_LIMIT_REACHED", ("a", "f"): "SUPPORTED", ("x", "z"): "SUPPORTED", ("z", "x"): "NO_STATIC_PATH_FOUND", ("a", "a"): "SUPPORTED"}
    nodes = spark.createDataFrame([(x,) for x in "atcdefgxyz"], "id string")
    assert {(r["id"], r["component"]) for r in graph.strong_components(nodes, adj).collect()} == {(x, "x" if x == "y" else x) for x in "atcdefgxyz"}


def test_innermost_span(spark):
    spans = spark.createDataFrame([("f", "outer", 0, 9000), ("f", "inner", 100, 200), ("g", "x", 0, 5)], "path string, symbol_id string, start_byte long, end_byte long")
    points = spark.createDataFrame([("f", 150), ("f", 5000), ("f", 9000), ("g", 4)], "path string, at long")
    assert {(r["path"], r["at"], r["symbol_id"]) for r in structure.innermost(points, spans).collect()} == {("f", 150, "inner"), ("f", 5000, "outer"), ("g", 4, "x")}


def test_engine_end_to_end(spark, tmp_path):
    repo = tmp_path / "repo"
    for p, text in FILES.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(text)
    (repo / "node_modules").mkdir()
    (repo / "node_modules/x.js").write_text("function no() {}")
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    e = Engine(spark, f"file://{tmp_path}/store")
    first = e.index(str(repo))
    assert first["files"] == len(FILES) and first["mode"] == "full" and e.index(str(repo))["mode"] == "noop"
    assert e.index(str(repo), "HEAD")["version_key"] == first["version_key"]
    t = e.trace("main", "saveOrder")
    assert t["status"] == "SUPPORTED" and [x.split("::")[1] for x in t["paths"][0]] == ["main", "startOrder", "placeOrder", "saveOrder"]
    assert e.trace("saveOrder", "main")["status"] == "NO_STATIC_PATH_FOUND"
    got = e.search("how does main reach saveOrder")
    assert got["intent"] == "PATH" and got["paths"]["status"] == "SUPPORTED" and got["match_basis"] == "KEYWORD_MATCH"
    assert {"saveOrder", "main"} <= {r["qualified_name"] for r in got["results"][:4]}
    tables = e.tables()
    status = lambda q: investigate.ground(spark.createDataFrame([(0, q)], "query_id int, query string"), tables["symbols"], tables["edges"]).first()["status"]
    assert status("does startOrder call placeOrder") == "VERIFIED_CALL"
    assert status("does saveOrder call main") == "CALL_NOT_ESTABLISHED"
    assert status("where is KafkaConsumer defined") == "NO_VERIFIED_SYMBOL"
    assert e.source("config.js", 1, 1) == ["export const config = 1;"]
    with pytest.raises(ValueError):
        e.source("../x", 1, 1)
    (repo / "controller.js").write_text(FILES["controller.js"].replace("return x;", "return x + 1;"))
    e.index(str(repo))
    old, new = e.tables("HEAD"), e.tables()
    changed = versions.symbol_changes(old["symbols"], new["symbols"]).collect()
    assert [(r["symbol_id"], r["change"]) for r in changed] == [("controller.js::saveOrder", "modified")]
    assert versions.edge_changes(old["edges"], new["edges"], ["src", "dst", "edge_type", "expression"]).count() == 0
