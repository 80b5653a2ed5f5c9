"""Exact dense retrieval over stored vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.vectors import axpy, dot, unit
from sparkloom.operators import rankings
from sparkloom.settings import DEFAULT


#: Up to so many queries are broadcast as rows; more are dealt to blocks that meet blocks of documents by their number.
QUERIES, BLOCK = 5000, 2048


def _met(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Every row of ``queries`` with every row of ``docs``: a broadcast of few queries, else an equi-join of blocks.

    Beyond the bound, queries are dealt to blocks of BLOCK and every document is sent once to each block.
    """
    n = queries.limit(QUERIES + 1).count()
    if n <= QUERIES:
        return docs.crossJoin(F.broadcast(queries))  # few by count
    blocks = -(-queries.count() // BLOCK)
    dealt = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return docs.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_b").drop("_b")


def scores(queries: DataFrame, docs: DataFrame, threshold: float | None = DEFAULT.semantic_threshold) -> DataFrame:
    """query_id, doc_id, score above the threshold: every query (query_id, qvec) meets every document (doc_id, vector)."""
    out = _met(queries, docs).select("query_id", "doc_id", F.round(dot(F.col("qvec"), F.col("vector")), 9).alias("score"))
    return out if threshold is None else out.where(F.col("score") > threshold)


def best_scores(queries: DataFrame, docs: DataFrame, k: int, threshold: float | None = DEFAULT.semantic_threshold) -> DataFrame:
    """The k best of each query with their ranks, ties by doc_id as text; k rows a query and task are shuffled up to k = 1000."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").cast("string"))
    return scores(queries, docs, threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def max_pool(queries: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id, doc_id, score: the best window (doc_id, vector) of each document; -1 for a document without windows."""
    best = rankings.pooled(queries.select("query_id", F.col("qvec").alias("vector")), windows.where("vector is not null").select("doc_id", "vector"))
    none = windows.groupBy("doc_id").agg(F.count("vector").alias("n")).where("n = 0")
    none = _met(queries.select("query_id"), none).select("query_id", "doc_id", F.lit(-1.0).alias("score"))
    return best.unionByName(none)


def feedback(queries: DataFrame, docs: DataFrame, first: DataFrame, beta: float = 0.3, k: int = 3) -> DataFrame:
    """query_id, qvec after pseudo-relevance feedback: the unit vector of q + beta * mean of its k best documents.

    ``first`` is the first ranking (query_id, doc_id, rank).
    """
    top = first.where(F.col("rank") <= k).join(docs, "doc_id").select("query_id", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x"))
    mean = top.groupBy("query_id", "i").agg(F.avg("x").alias("x")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean"))
    return queries.join(mean, "query_id").select("query_id", unit(axpy(F.col("qvec"), beta, F.col("mean"))).alias("qvec"))


def pooled(chunks: DataFrame) -> DataFrame:
    """query_id, qvec: token-weighted means of chunk vectors (query_id, vector, n_tokens), made unit again."""
    x = chunks.select("query_id", "n_tokens", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x"))
    m = x.groupBy("query_id", "i").agg((F.sum(F.col("x") * F.col("n_tokens")) / F.sum("n_tokens")).alias("x"))
    return m.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v")).select("query_id", unit(F.col("v")).alias("qvec"))


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """``texts`` with a column vector from a pluggable encoder, in Arrow batches."""
    from pyspark.sql import types as T

    schema = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(vector=[v.astype(np.float32).tolist() for v in encoder(pdf[text].tolist())]) if len(pdf) else pdf.assign(vector=[])

    return texts.mapInPandas(run, schema)


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed hashed token counts, made unit."""

    def run(texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return run


def windows(docs: DataFrame, size: int = 256, overlap: int = 64, text: str = "text") -> DataFrame:
    """doc_id, window_no, tokens: overlapping windows of words; a short text is one window."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    stride = size - overlap
    starts = F.when(F.size("_w") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(stride)))
    cut = docs.select("doc_id", words.alias("_w")).select("doc_id", "_w", F.posexplode(starts).alias("window_no", "_s"))
    return cut.select("doc_id", "window_no", F.slice("_w", F.col("_s") + 1, F.lit(size)).alias("tokens"))
