"""Rankings combined: reciprocal rank fusion, linear fusion, sweeps, and the full ranking with boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import bounded, code_tokens
from sparkloom.operators._size import small
from sparkloom.operators.lexical import ranked
from sparkloom.settings import DEFAULT, MODES, Settings


def rrf(runs: list[tuple[DataFrame, float]], k: int = DEFAULT.rrf_k, depth: int = 1000, keep: int = 1000) -> DataFrame:
    """query_id, doc_id, score, rank: sums of weight / (k + rank) over runs (query_id, doc_id, rank) cut at a depth."""
    parts = None
    for run, weight in runs:
        p = run.where(F.col("rank") <= depth).select("query_id", "doc_id", (F.lit(weight) / (F.lit(k) + F.col("rank"))).alias("s"))
        parts = p if parts is None else parts.unionByName(p)
    return ranked(parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 12).alias("score")), keep)


def sweep(lexical: DataFrame, semantic: DataFrame, ks: list[int], weights: list[float], depths: list[int]) -> DataFrame:
    """k, w, depth, query_id, doc_id, score, rank for every setting in one job; w weighs the semantic run against 1 - w."""
    spark = lexical.sparkSession
    conf = spark.createDataFrame([(k, w, d) for k in ks for w in weights for d in depths], "k int, w double, depth int")
    both = lexical.select("query_id", "doc_id", "rank", F.lit(0).alias("side")).unionByName(semantic.select("query_id", "doc_id", "rank", F.lit(1).alias("side")))
    part = both.join(F.broadcast(conf), F.col("rank") <= F.col("depth"))  # the table of settings is given by the caller
    s = F.when(F.col("side") == 1, F.col("w")).otherwise(1 - F.col("w")) / (F.col("k") + F.col("rank"))
    score = part.groupBy("k", "w", "depth", "query_id", "doc_id").agg(F.round(F.sum(s), 12).alias("score"))
    order = Window.partitionBy("k", "w", "depth", "query_id").orderBy(F.desc("score"), F.col("doc_id").cast("string"))
    return score.withColumn("rank", F.row_number().over(order))


def linear(dense: DataFrame, lexical: DataFrame, lam: float) -> DataFrame:
    """query_id, doc_id, score = dense + lam * lexical / the query's largest lexical score."""
    top = F.max("lex").over(Window.partitionBy("query_id"))
    both = dense.select("query_id", "doc_id", F.col("score").alias("den")).join(lexical.select("query_id", "doc_id", F.col("score").alias("lex")), ["query_id", "doc_id"], "full_outer")
    both = both.withColumn("_top", top)
    s = F.coalesce("den", F.lit(0.0)) + F.lit(lam) * F.coalesce("lex", F.lit(0.0)) / F.greatest(F.coalesce("_top", F.lit(0.0)), F.lit(1e-9))
    return both.select("query_id", "doc_id", F.round(s, 9).alias("score"))


def rank(queries: DataFrame, chunks: DataFrame, lexical: DataFrame, semantic: DataFrame | None, mode: str = "hybrid", boosts: bool = True, settings: Settings = DEFAULT, limit: int | None = None, whole: bool = False) -> DataFrame:
    """The ranking of chunks for queries (query_id, query), with its evidence.

    ``chunks`` has doc_id, qualified_name, kind, is_test; ``lexical`` and ``semantic`` scores above their thresholds.
    Scores are reciprocal ranks, in single modes too, plus boosts for named symbols, times a weight for tests that
    nobody asked for.  An unknown mode is an error.  The ranking has as many rows as one run has candidates; ``whole``
    keeps those of both.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    size = max(settings.candidates, limit or 0)
    lex = ranked(lexical, size).select("query_id", "doc_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    if semantic is None:
        both = lex.withColumns({"semantic_score": F.lit(None).cast("double"), "semantic_rank": F.lit(None).cast("int")})
    else:
        sem = ranked(semantic, size).select("query_id", "doc_id", F.col("score").alias("semantic_score"), F.col("rank").alias("semantic_rank"))
        both = lex.join(sem, ["query_id", "doc_id"], {"bm25": "left", "dense": "right", "hybrid": "full_outer"}[mode])
    rows = both.join(chunks.select("doc_id", "qualified_name", "kind", "is_test"), "doc_id").join(small(queries.select("query_id", "query")), "query_id")
    terms = F.array_distinct(code_tokens(F.col("query")))
    overlap = F.size(F.array_intersect(terms, code_tokens(F.col("qualified_name")))) / F.greatest(F.lit(1), F.size(terms))
    name = F.lower(F.element_at(F.split("qualified_name", r"\."), -1))
    words = F.transform(F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}_$]+"), 0), F.lower)
    exact = (F.col("kind") != "dataset_document") & (F.array_contains(words, name) | bounded(F.col("query"), F.col("qualified_name"), insensitive=True))
    rows = rows.withColumn("exact_symbol_match", F.coalesce(exact, F.lit(False))).withColumn("name_overlap", overlap if boosts else F.lit(0.0))
    part = lambda r, w, off: F.lit(0.0) if mode == off else F.coalesce(F.lit(w) / (F.lit(settings.rrf_k) + F.col(r)), F.lit(0.0))
    base = part("lexical_rank", settings.lexical_weight, "dense") + part("semantic_rank", settings.semantic_weight, "bm25")
    if boosts:
        base = base + F.when(F.col("exact_symbol_match"), settings.exact_boost).otherwise(0.0) + F.lit(settings.name_boost) * F.col("name_overlap")
        base = base * F.when(F.col("is_test") & ~F.col("query").rlike(r"(?i)\b(test|tests|spec)\b"), settings.test_weight).otherwise(1.0)
    return ranked(rows.withColumn("score", F.round(base, 12)), 2 * size if whole else size).select("query_id", "doc_id", "rank", "score", "lexical_rank", "semantic_rank", "lexical_score", "semantic_score", "exact_symbol_match", "name_overlap")


def match_basis(results: DataFrame) -> DataFrame:
    """query_id, match_basis: KEYWORD_MATCH if some result has a lexical rank or names a symbol, else SEMANTIC_ONLY."""
    keyword = F.bool_or(F.col("lexical_rank").isNotNull() | F.col("exact_symbol_match"))
    return results.groupBy("query_id").agg(F.when(keyword, "KEYWORD_MATCH").otherwise("SEMANTIC_ONLY").alias("match_basis"))


def refine(first: DataFrame, second: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Scores of a first pass with those of a second, refined query added by rank."""
    more = second.select("query_id", "doc_id", (F.lit(settings.refinement_weight) / (F.lit(settings.rrf_k) + F.col("rank"))).alias("s"))
    return first.select("query_id", "doc_id", F.col("score").alias("s")).unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 12).alias("score"))
