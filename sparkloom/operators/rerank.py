"""Rerankers: operator evidence, features with a confidence gate, pairwise training, a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import name_terms, operator_evidence
from sparkloom.operators._size import small

# fixed values: the features in their order
FEATURES = ("dense", "word_overlap", "rare_overlap", "identifier_overlap", "number_overlap", "operator_overlap", "document_log_tokens")
# fixed values: keywords that are written like names, and the operator words among a question's terms
CAPITAL_KEYWORDS = ("False", "None", "True")
OPERATORS = ("xor", "gcd", "lcm", "modulo", "sort", "binary", "factorial", "prime", "palindrome")


def boost_operators(run: DataFrame, depth: int = 50, boost: float = 0.02) -> DataFrame:
    """query_id, doc_id, score: rows of a run (query_id, doc_id, query, text, score, rank) within ``depth`` gain a
    boost where the text shows an operator that the query names."""
    hit = (F.col("rank") <= depth) & operator_evidence(F.col("query"), F.col("text"))
    return run.select("query_id", "doc_id", F.round(F.col("score") + F.when(hit, boost).otherwise(0.0), 9).alias("score"))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1.0), whole.cast("double"))


def _idf_sum(words: Column, idf: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(idf[w], F.lit(0.0)))


def term_idf(docs: DataFrame) -> DataFrame:
    """term, idf = ln((N + 1) / (df + 1)) + 1 over the distinct terms of each text."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select("doc_id", F.explode(name_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def features(run: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """A run (query_id, doc_id, query, text, score) with the columns of FEATURES.

    Term weights are joined by term, only for terms that a query and a document share or a query has.
    """
    q, d = name_terms(F.col("query")), name_terms(F.col("text"))
    rows = run.withColumn("_q", q).withColumn("_d", d).withColumn("_s", F.array_intersect("_q", "_d"))
    names = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z_0-9]*"), 0), lambda n: (n.contains("_") | (F.lower(n) != n)) & ~n.isin(*CAPITAL_KEYWORDS))
    names = F.array_distinct(F.transform(names, F.lower))
    qnames = F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit("[A-Za-z_][A-Za-z_0-9]*"), 0), F.lower))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b[0-9]{2,}\b"), 0))
    ops = F.array(*[F.lit(o) for o in OPERATORS])
    qops = F.array_intersect(ops, F.col("_q"))
    out = rows.withColumns(
        {
            "dense": F.col("score"),
            "word_overlap": _ratio(F.size("_s"), F.size("_q")),
            "identifier_overlap": _ratio(F.size(F.array_intersect(names, qnames)), F.size(qnames)),
            "number_overlap": _ratio(F.size(F.array_intersect(numbers("query"), numbers("text"))), F.size(numbers("query"))),
            "operator_overlap": _ratio(F.size(F.array_intersect(qops, F.col("_d"))), F.size(qops)),
            "document_log_tokens": F.log1p(F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+"), 0)).cast("double")),
        }
    )
    if idf is None:
        return out.withColumn("rare_overlap", F.lit(0.0)).drop("_q", "_d", "_s")
    queries = out.select("query_id", F.explode("_q").alias("term")).distinct().join(idf, "term")
    total = queries.groupBy("query_id").agg(F.sum("idf").alias("_all"))
    shared = out.select("query_id", "doc_id", F.explode("_s").alias("term")).join(queries, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("idf").alias("_part"))
    out = out.join(total, "query_id", "left").join(shared, ["query_id", "doc_id"], "left")
    rare = F.coalesce("_part", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce("_all", F.lit(0.0)))
    return out.withColumn("rare_overlap", rare).drop("_q", "_d", "_s", "_all", "_part")


def feature_score(mean: list[float], scale: list[float], coef: list[float]) -> Column:
    """The linear score of standardised features."""
    out = F.lit(0.0)
    for name, m, s, c in zip(FEATURES, mean, scale, coef, strict=True):
        out = out + (F.col(name) - m) / s * c
    return F.round(out, 9)


def keep_tail(run: DataFrame, depth: int = 50, new: str = "new_score", head: DataFrame | None = None) -> DataFrame:
    """The run with its first ``depth`` rows ordered by the new score and the others as they were.

    With ``head``, the first ``depth`` rows of a run whose ranks count from 1 without gaps, only those are sorted.
    """
    if head is not None:
        first = Window.partitionBy("query_id").orderBy(F.desc(new), "rank")
        tail = run.where(F.col("rank") > depth).withColumn("new_rank", F.col("rank"))
        return head.withColumn("new_rank", F.row_number().over(first)).unionByName(tail)
    order = Window.partitionBy("query_id").orderBy(F.col("rank") > depth, F.when(F.col("rank") <= depth, -F.col(new)).otherwise(0.0), "rank")
    return run.withColumn("new_rank", F.row_number().over(order))


def margins(run: DataFrame) -> DataFrame:
    """query_id, top1_top2, top1_top10, top10_top11 of a run (query_id, score, rank) of eleven or more."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    t = run.where("rank <= 11").groupBy("query_id").agg(at(1).alias("a"), at(2).alias("b"), at(10).alias("j"), at(11).alias("k"), F.count("*").alias("n"))
    return t.where("n = 11").select("query_id", F.round(F.col("a") - F.col("b"), 9).alias("top1_top2"), F.round(F.col("a") - F.col("j"), 9).alias("top1_top10"), F.round(F.col("j") - F.col("k"), 9).alias("top10_top11"))


def gated(run: DataFrame, measure: str, threshold: float, depth: int = 50, new: str = "new_score", head: DataFrame | None = None) -> DataFrame:
    """keep_tail for queries whose margin is at most the threshold; the others keep their order."""
    if measure not in ("top1_top2", "top1_top10", "top10_top11"):
        raise ValueError(f"unknown measure {measure!r}")
    m = margins(run if head is None else head).select("query_id", (F.col(measure) <= threshold).alias("triggered"))
    both = keep_tail(run, depth, new, head).join(small(m), "query_id", "left").withColumn("triggered", F.coalesce("triggered", F.lit(False)))
    return both.withColumn("new_rank", F.when(F.col("triggered"), F.col("new_rank")).otherwise(F.col("rank")))


def pairwise_fit(pairs: DataFrame, reg: float = 1.0):
    """Coefficients of a logistic ranker without intercept from rows (positive, negative: arrays of features).

    Each difference is taken both ways; the penalty follows C = 1 of the usual formulation, reg / rows here.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = F.zip_with("positive", "negative", lambda a, b: a - b)
    both = pairs.select(array_to_vector(d).alias("features"), F.lit(1.0).alias("label")).unionByName(pairs.select(array_to_vector(F.transform(d, lambda x: -x)).alias("features"), F.lit(0.0).alias("label")))
    n = both.count()
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=reg / max(1, n)).fit(both)
    return model.coefficients.toArray().tolist()


def rescore(run: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], depth: int = 50) -> DataFrame:
    """The run (query, text, rank) with new_score from a pluggable pair scorer, for the first ``depth`` rows alone."""
    from pyspark.sql import types as T

    schema = T.StructType([*run.schema.fields, T.StructField("new_score", T.DoubleType())])

    def score(batches):
        for pdf in batches:
            top = pdf["rank"] <= depth
            new = pd.Series([None] * len(pdf), index=pdf.index, dtype="float64")
            if top.any():
                new[top] = scorer(list(zip(pdf.loc[top, "query"], pdf.loc[top, "text"], strict=True)))
            yield pdf.assign(new_score=new)

    return run.mapInPandas(score, schema)
