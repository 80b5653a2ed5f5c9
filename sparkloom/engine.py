"""An engine over versions of repositories: index, search, trace, map, compare."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import dense, graph, investigate, lexical, structure, versions
from sparkloom.settings import DEFAULT, Settings
from sparkloom.sources import repositories, store


#: The longest question, path, version name and symbol that are looked at, in characters.
LONGEST = {"query": 32_000, "path": 4096, "version": 200, "symbol": 1000}


def checked(kind: str, value: str) -> str:
    """A text of a request; an empty one or one that is too long is an error."""
    if not isinstance(value, str) or not 1 <= len(value) <= LONGEST[kind]:
        raise ValueError(f"{kind}: 1 to {LONGEST[kind]} characters")
    return value


class Engine:
    """Versions live below ``folder``, each under a key made of its content and the settings; names are aliases of keys.

    Aliases are kept in ``folder`` too, so another engine on it knows them.  With an ``encoder`` (texts to vectors),
    chunks have vectors, of which only those of new texts are computed; ``model`` names it.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULT, encoder: Callable | None = None, model: str = "encoder"):
        self.spark, self.folder, self.settings, self.encoder, self.model = spark, folder, settings, encoder, model
        self.repo = ""

    # versions -------------------------------------------------------------------------------------------------

    def _read(self, repo: str, version: str) -> tuple[DataFrame, DataFrame, str]:
        """(files, warnings, key): the key follows the files' content and the settings."""
        read = repositories.working_tree if version == "working-tree" else lambda s, r, x: repositories.revision(s, r, version, x)
        files, warnings = read(self.spark, repo, self.settings)
        files = files.cache()
        content = versions.snapshot_hash(files.withColumn("version_key", F.lit("x"))).first()
        parts = [content["snapshot_hash"] if content else "", self.settings.fingerprint(), self.model if self.encoder else ""]
        return files, warnings, hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:24]

    def index(self, repo: str, version: str = "working-tree") -> dict:
        """Reads, parses, resolves and stores a version, and makes it the one that its name stands for.

        ``mode`` is noop for a version that is stored already, incremental if unchanged files of the last version of
        that name were not read again, else full.  A failure leaves names and stored versions as they were.
        """
        files, warnings, key = self._read(checked("path", repo), checked("version", version))
        before = store.alias(self.spark, self.folder, repo, version)
        if store.stored(self.spark, self.folder, key):
            manifest, mode = self._load(key)[1], "noop"
        else:
            known = self._load(before)[0]["parsed"] if before and store.stored(self.spark, self.folder, before) else None
            hashed = files.withColumn("file_hash", F.sha2("source", 256))
            same = hashed.select("path", "file_hash").join(known, ["path", "file_hash"]) if known is not None else None
            n_same = same.count() if same is not None else 0
            new = hashed.join(same.select("path"), "path", "left_anti") if n_same else hashed
            read = structure.parse(new).join(new.select("path", "file_hash"), "path")
            parsed = (read.unionByName(same) if n_same else read).cache()
            edges, unresolved = structure.resolve_calls(parsed.drop("file_hash"))
            chunks = structure.chunks(parsed).withColumn("text_hash", F.sha2("text", 256)).cache()
            tables = {"files": files, "parsed": parsed, "symbols": structure.symbols(parsed), "chunks": chunks, "edges": edges, "unresolved": unresolved, "sequences": structure.sequences(edges)}
            if self.encoder:
                tables["vectors"] = self._vectors(chunks)
            manifest = {"version_key": key, "files": files.count(), "reused_files": n_same, "warnings": [r["warning"] for r in warnings.limit(100).collect()]}
            store.save_index(tables, self.folder, key, manifest)
            parsed.unpersist(), chunks.unpersist()
            mode = "incremental" if n_same else "full"
        files.unpersist()
        self.repo = repo
        store.put_alias(self.spark, self.folder, repo, version, key)
        return manifest | {"mode": mode}

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        """doc_id, vector of all chunks; texts that the cache lacks are encoded and kept."""
        path = f"{self.folder}/vectors"
        cache = store.cache(self.spark, path)
        new = dense.encode(store.missing_vectors(chunks, cache, self.model), self.encoder)
        store.put_vectors(new.select(F.lit(self.model).alias("model"), "text_hash", "vector"), path)
        return store.with_vectors(chunks.select("doc_id", "text_hash"), store.cache(self.spark, path), self.model).select("doc_id", "vector")

    def _load(self, key: str) -> tuple[dict[str, DataFrame], dict]:
        if not store.stored(self.spark, self.folder, key):
            raise ValueError(f"no version {key}")
        return store.load_index(self.spark, self.folder, key)

    def key(self, version: str = "working-tree") -> str:
        """The key that a name of the active repository stands for; any other name is a key itself."""
        return store.alias(self.spark, self.folder, self.repo, checked("version", version)) or version

    def tables(self, version: str = "working-tree") -> dict[str, DataFrame]:
        """The tables of a version, by its name in the active repository or by its key."""
        return self._load(self.key(version))[0]

    def versions(self) -> DataFrame:
        """repo, version, version_key, set_at of all names."""
        return store.aliases(self.spark, self.folder)

    def status(self, version: str = "working-tree") -> dict:
        """What is stored of a version, and whether its vectors can be searched."""
        tables, manifest = self._load(self.key(version))
        return manifest | {"tables": sorted(tables), "semantic": "vectors" in tables and self.encoder is not None, "unresolved": tables["unresolved"].count()}

    def changed(self, repo: str, version: str = "working-tree") -> bool:
        """Whether the files differ from what the name stands for; nothing is stored."""
        files, _, key = self._read(repo, version)
        files.unpersist()
        return store.alias(self.spark, self.folder, repo, version) != key

    # questions ------------------------------------------------------------------------------------------------

    def search(self, query: str, version: str = "working-tree", top_k: int = 10, agentic: bool = True, mode: str | None = None) -> dict:
        """investigate() over a stored version, with its vectors if it has some; the mode is that of the settings."""
        query = checked("query", checked("query", query).strip())
        if not 1 <= top_k <= 50:
            raise ValueError("top_k out of 1 to 50")
        key = self.key(version)
        t = self._load(key)[0]
        docs, semantic = t["chunks"], None
        if self.encoder and "vectors" in t and (mode or self.settings.retrieval) != "bm25":
            asked = self.spark.createDataFrame([(0, [float(x) for x in self.encoder([query])[0]])], "query_id int, qvec array<double>")
            semantic = dense.scores(asked, t["vectors"], self.settings.semantic_threshold)
        found = investigate.investigate(
            query, docs, t["symbols"], t["edges"], lexical.build(docs, title="qualified_name"), semantic, mode or self.settings.retrieval, top_k, agentic, self.settings
        )
        return found | {"version_key": key}

    def trace(self, source: str, target: str, version: str = "working-tree", max_depth: int = 5) -> dict:
        """Paths of calls between two symbols, with the symbols and calls on them."""
        if not 1 <= max_depth <= 8:
            raise ValueError("max_depth out of 1 to 8")
        t = self.tables(version)
        source, target = checked("symbol", source), checked("symbol", target)
        found = graph.trace(t["symbols"], self._adjacency(t), source, target, max_depth)
        nodes, edges = graph.subgraph(t["symbols"], t["edges"], self.spark.createDataFrame([(x,) for x in found["ids"]], "id string"))
        if investigate.invalid_graph(nodes, edges, t["symbols"], t["edges"], t["files"]).limit(1).count():
            raise ValueError("a path does not agree with the stored source")
        return found | {"nodes": [r.asDict() for r in nodes.orderBy("symbol_id").collect()], "edges": [r.asDict() for r in edges.select("src", "dst", "line", "how").orderBy("src", "dst", "line").collect()]}  # of 20 paths

    def _adjacency(self, t: dict[str, DataFrame]) -> DataFrame:
        return graph.adjacency(t["symbols"].where(F.col("kind") != "class").select(F.col("symbol_id").alias("id")), t["edges"])

    def map(self, version: str = "working-tree", file: str | None = None, symbol: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): the most connected files and which calls which, or the symbols of a file, or those near a symbol."""
        t = self.tables(version)
        if symbol is not None:
            if not 1 <= depth <= 3:
                raise ValueError("depth out of 1 to 3")
            near, _ = graph.neighbourhood(self._adjacency(t), self.spark.createDataFrame([(symbol,)], "id string"), depth)
            return graph.subgraph(t["symbols"], t["edges"], near.select("id"))
        return graph.file_map(t["edges"], t["symbols"]) if file is None else graph.symbol_map(t["symbols"], t["edges"], file)

    def symbol(self, symbol_id: str, version: str = "working-tree") -> dict | None:
        """One symbol."""
        row = self.tables(version)["symbols"].where(F.col("symbol_id") == symbol_id).first()
        return row.asDict() if row else None

    def source(self, path: str, first: int, last: int, version: str = "working-tree") -> list[str]:
        """Lines of a stored file."""
        return [r["text"] for r in repositories.source_lines(self.tables(version)["files"], path, first, last).orderBy("line").collect()]

    def compare(self, query: str, a: str, b: str) -> dict:
        """Symbols, calls and ranks of a question that differ between two versions, and which of them touch its results."""
        x, y = self.tables(a), self.tables(b)
        ra, rb = self.search(query, a), self.search(query, b)
        ranks = lambda r: self.spark.createDataFrame([(i["doc_id"], i["rank"]) for i in r["results"]], "symbol_id string, rank int")
        symbols, edges = versions.symbol_changes(x["symbols"], y["symbols"]), versions.edge_changes(x["edges"], y["edges"], ["src", "dst", "edge_type", "expression"])
        near = versions.relevant_changes(symbols, edges, ranks(ra).union(ranks(rb)))
        return {
            "results_a": ra, "results_b": rb, "symbols": symbols, "edges": edges, "ranks": versions.rank_changes(ranks(ra), ranks(rb)), "relevant_symbols": near[0], "relevant_edges": near[1],
        }
