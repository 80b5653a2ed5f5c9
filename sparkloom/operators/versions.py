"""Snapshots compared: files, symbols, edges, ranks, and content that several versions share."""

from __future__ import annotations

import hashlib
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import lines
from sparkloom.operators import fusion, lexical


def snapshot_hash(files: DataFrame) -> DataFrame:
    """version_key, snapshot_hash: sha-256 over path NUL source NUL in order of paths.

    Files of a version come sorted to one task, which hashes them as a stream: no version has to fit in memory.  Rows
    without a path or source add nothing.
    """

    def run(batches):
        key, digest, open_ = None, None, False
        for batch in batches:
            out = []
            for version, path, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not open_ or version != key:
                    if open_:
                        out.append((key, digest.hexdigest()))
                    key, digest, open_ = version, hashlib.sha256(), True
                if path is not None and source is not None:
                    digest.update(f"{path}\0{source}\0".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], ["version_key", "snapshot_hash"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, digest.hexdigest())] if key is not None else [pa.array([None], pa.string()), pa.array([digest.hexdigest()])], ["version_key", "snapshot_hash"])

    rows = files.select(F.col("version_key").cast("string").alias("version_key"), "path", "source").repartition("version_key").sortWithinPartitions("version_key", "path")
    return rows.mapInArrow(run, "version_key string, snapshot_hash string")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, deleted, modified, unchanged, renamed), renamed_from over files (path, content_sha).

    A rename pairs one added with one deleted file of equal content: the added in order of paths take the deleted
    from the last.
    """
    both = old.select("path", F.col("content_sha").alias("a")).join(new.select("path", F.col("content_sha").alias("b")), "path", "full_outer")
    both = both.withColumn("change", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified").otherwise("unchanged"))
    added = both.where("change = 'added'").select("path", F.col("b").alias("sha")).withColumn("n", F.row_number().over(Window.partitionBy("sha").orderBy("path")))
    gone = both.where("change = 'deleted'").select(F.col("path").alias("renamed_from"), F.col("a").alias("sha")).withColumn("n", F.row_number().over(Window.partitionBy("sha").orderBy(F.desc("renamed_from"))))
    pairs = added.join(gone, ["sha", "n"]).select("path", "renamed_from")
    out = both.join(pairs, "path", "left").join(pairs.select(F.col("renamed_from").alias("path")), "path", "left_anti")
    return out.select("path", F.when(F.col("renamed_from").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "renamed_from")


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: added, modified, deleted, renamed, unchanged."""
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted", "renamed", "unchanged")])


def symbol_changes(old: DataFrame, new: DataFrame, least: float = 0.96) -> DataFrame:
    """symbol_id, change (added, removed, modified, moved), moved_to.

    Symbols (symbol_id, qualified_name, content_hash, source_text).  A removed symbol moved if exactly one added one
    has its name and an equal or nearly equal body; the removed are tried in order and an added one is taken once.
    """
    both = old.alias("o").join(new.alias("n"), "symbol_id", "full_outer").select("symbol_id", F.col("o.content_hash").alias("a"), F.col("n.content_hash").alias("b"), F.coalesce("o.qualified_name", "n.qualified_name").alias("qualified_name"), F.coalesce("o.source_text", "n.source_text").alias("source_text"))
    both = both.withColumn("change", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified"))
    ends = both.where("change in ('added', 'removed')").select("symbol_id", "qualified_name", "change", F.coalesce("a", "b").alias("hash"), "source_text")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        free = pdf[pdf["change"] == "added"].sort_values("symbol_id")
        rows, taken = [], set()
        for old_ in pdf[pdf["change"] == "removed"].sort_values("symbol_id").itertuples():
            fits = [n.symbol_id for n in free.itertuples() if n.symbol_id not in taken and (n.hash == old_.hash or SequenceMatcher(None, old_.source_text, n.source_text).ratio() >= least)]
            if len(fits) == 1:
                taken.add(fits[0])
                rows.append((old_.symbol_id, fits[0]))
        return pd.DataFrame(rows, columns=["symbol_id", "moved_to"])

    moved = ends.groupBy("qualified_name").applyInPandas(pair, "symbol_id string, moved_to string")
    out = both.where("change is not null").join(moved, "symbol_id", "left").join(moved.select(F.col("moved_to").alias("symbol_id")), "symbol_id", "left_anti")
    return out.select("symbol_id", F.when(F.col("moved_to").isNotNull(), "moved").otherwise(F.col("change")).alias("change"), "moved_to")


def edge_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The key columns, change (added, removed) and copy number of edges that one side has more often."""
    n = lambda d: d.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy(*key)).alias("copy"))
    a, b = n(old), n(new)
    on = [*key, "copy"]
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, on, "left_anti").withColumn("change", F.lit("removed")))


def rank_changes(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The columns ``by`` (those of a query), symbol_id, rank_a, rank_b, delta (null unless both), position among equal ``by``."""
    by = by or []
    both = a.select(*by, "symbol_id", F.col("rank").alias("rank_a")).join(b.select(*by, "symbol_id", F.col("rank").alias("rank_b")), [*by, "symbol_id"], "full_outer")
    both = both.withColumn("delta", F.col("rank_a") - F.col("rank_b"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce("rank_b", F.lit(100)), "symbol_id")))


def fold(snippets: DataFrame) -> DataFrame:
    """content_hash, text, n_occurrences, versions, members: identical texts of (version, version_order, doc_id, text) once."""
    rows = snippets.withColumn("content_hash", F.sha2("text", 256))
    got = rows.groupBy("content_hash").agg(F.min("text").alias("text"), F.count("*").alias("n_occurrences"), F.sort_array(F.collect_list(F.struct("version_order", "doc_id", "version"))).alias("m"))
    return got.select("content_hash", "text", "n_occurrences", F.array_distinct(F.transform("m", lambda x: x["version"])).alias("versions"), F.transform("m", lambda x: F.struct(x["version"].alias("version"), x["doc_id"].alias("doc_id"))).alias("members"))


def snippet_search(queries: DataFrame, snippets: DataFrame, semantic: DataFrame | None = None, mode: str = "bm25", k: int = 10) -> DataFrame:
    """The k best distinct texts of all versions for each query (query_id, query): rank, score, id, versions, occurrences,
    lines, text and the ranks they come from.

    ``snippets`` is (version, version_order, doc_id, text); equal texts are searched once and list all that hold them.
    ``semantic`` (query_id, doc_id: content hash, score) are scores of their vectors.  Nothing is boosted.
    """
    folded = fold(snippets)
    units = folded.select(F.col("content_hash").alias("doc_id"), "text", F.lit("").alias("qualified_name"), F.lit("dataset_document").alias("kind"), F.lit(False).alias("is_test"))
    found = fusion.rank(queries, units, lexical.scores(lexical.build(units), queries), semantic, mode, boosts=False, limit=k).where(F.col("rank") <= k)
    rows = found.join(folded, found["doc_id"] == folded["content_hash"])
    return rows.select(
        "query_id", "rank", F.round("score", 6).alias("score"), F.element_at("members", 1)["doc_id"].alias("id"), F.sort_array("versions").alias("versions"),
        F.transform("members", lambda m: F.concat_ws(":", m["version"], m["doc_id"].cast("string"))).alias("occurrences"), F.greatest(F.lit(1), F.size(lines(F.col("text")))).alias("lines"), "text", "lexical_rank", "semantic_rank",
    )


def relevant_changes(symbols: DataFrame, edges: DataFrame, ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol changes, edge changes) that touch a ranked symbol (symbol_id): of the results of two versions."""
    ids = ranked.select("symbol_id").distinct()
    near = edges.join(F.broadcast(ids.withColumnsRenamed({"symbol_id": "src"}).withColumn("_a", F.lit(True))), "src", "left").join(F.broadcast(ids.withColumnsRenamed({"symbol_id": "dst"}).withColumn("_b", F.lit(True))), "dst", "left")  # the results of one question
    return symbols.where("change != 'moved'").join(F.broadcast(ids), "symbol_id", "left_semi"), near.where("_a or _b").drop("_a", "_b")
