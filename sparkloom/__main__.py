"""The engine on the command line: python -m sparkloom STORE COMMAND ...; results are JSON."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from sparkloom.engine import Engine
from sparkloom.operators.dense import hashing_encoder


def _plain(x):
    """Rows of DataFrames as dicts; what is shown is bounded by the operators."""
    if isinstance(x, DataFrame):
        return [r.asDict(recursive=True) for r in x.collect()]
    if isinstance(x, tuple):
        return dict(zip(("nodes", "edges"), map(_plain, x), strict=True))
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("store")
    p.add_argument("--repo", default="")
    p.add_argument("--vectors", action="store_true", help="with the built-in hashing encoder")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(*a[:1], **(a[1] if len(a) > 1 else {})) for a in args]
    version = ("--version", {"default": "working-tree"})
    add("index", ("path",), version)
    add("search", ("query",), version, ("--top-k", {"type": int, "default": 10}), ("--mode", {"choices": ["bm25", "dense", "hybrid"]}))
    add("trace", ("source",), ("target",), version, ("--max-depth", {"type": int, "default": 5}))
    add("map", version, ("--file", {}), ("--symbol", {}), ("--depth", {"type": int, "default": 1}))
    add("source", ("path",), ("first", {"type": int}), ("last", {"type": int}), version)
    add("compare", ("query",), ("a",), ("b",))
    add("status", version)
    add("versions")
    return p


def run(spark: SparkSession, argv: list[str]) -> str:
    """The JSON of one command."""
    a = parser().parse_args(argv)
    e = Engine(spark, a.store, encoder=hashing_encoder() if a.vectors else None, model="hashing-64")
    e.repo = a.repo
    got = {
        "index": lambda: e.index(a.path, a.version), "search": lambda: e.search(a.query, a.version, a.top_k, mode=a.mode), "trace": lambda: e.trace(a.source, a.target, a.version, a.max_depth),
        "map": lambda: e.map(a.version, a.file, a.symbol, a.depth), "source": lambda: e.source(a.path, a.first, a.last, a.version), "compare": lambda: e.compare(a.query, a.a, a.b),
        "status": lambda: e.status(a.version), "versions": lambda: e.versions(),
    }[a.command]()
    return json.dumps(_plain(got), default=str, sort_keys=True)


if __name__ == "__main__":
    import sys

    print(run(SparkSession.builder.getOrCreate(), sys.argv[1:]))
