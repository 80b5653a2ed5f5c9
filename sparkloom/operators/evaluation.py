"""Evaluation of rankings: runs (query_id, doc_id, rank) against judgements (query_id, doc_id, grade)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Judged:
    """Positive judgements of a run's documents (query_id, doc_id, grade), and of all documents their number: query_id, grade, n.

    What looks at a run's documents and at how many there are needs no row for every judgement.
    """

    pairs: DataFrame
    totals: DataFrame


def judged(qrels: DataFrame | Judged) -> Judged:
    if isinstance(qrels, Judged):
        return qrels
    good = qrels.where("grade > 0")
    return Judged(good, good.groupBy("query_id", "grade").agg(F.count("*").alias("n")))


def distinct_run(run: DataFrame) -> DataFrame:
    """A run whose repeated documents count at their first rank only; later ones move up."""
    first = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))


def reject_repeats(run: DataFrame) -> DataFrame:
    """The run; an error as it is read if a query has a document twice."""
    n = F.count("*").over(Window.partitionBy("query_id", "doc_id"))
    return run.withColumn("_n", n).withColumn("rank", F.when(F.col("_n") == 1, F.col("rank")).otherwise(F.raise_error(F.lit("a document is ranked twice")).cast("int"))).drop("_n")


def _gain(grade: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade.cast("double")


def metrics(run: DataFrame, qrels: DataFrame | Judged, k: int = 10, exponential: bool = False, mrr_depth: int | None = None, recalls: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """One row per judged query, whether the run has it or not: ndcg, mrr, recall_<n>.

    A query counts as judged if some document has a positive grade.  Linear or exponential gain; the reciprocal rank
    looks at the whole list unless ``mrr_depth`` cuts it.  The ideal comes from the numbers of each grade: equal grades
    take the next places.
    """
    known = judged(qrels)
    good = known.pairs.select("query_id", "doc_id", "grade")
    discount = lambda r: F.log2(F.col(r) + 1.0)
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0))
    places = F.sequence(F.col("_upto") - F.col("n") + 1, F.least(F.col("_upto"), F.lit(k)))
    gains = F.when(F.col("_upto") - F.col("n") < k, F.aggregate(places, F.lit(0.0), lambda s, i: s + _gain(F.col("grade"), exponential) / F.log2(i + 1.0))).otherwise(0.0)
    ideal = known.totals.withColumn("_upto", upto).groupBy("query_id").agg(F.sum(gains).alias("_ideal"), F.sum("n").alias("_n"))
    hit = good.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])
    seen = F.col("rank") <= mrr_depth if mrr_depth else F.lit(True)
    per = hit.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade"), exponential) / discount("rank")).otherwise(0.0)).alias("_dcg"),
        F.min(F.when(seen, F.col("rank"))).alias("_first"),
        *[F.count(F.when(F.col("rank") <= n, 1)).alias(f"_hit_{n}") for n in recalls],
    )
    both = ideal.join(per, "query_id", "left")
    return both.select(
        "query_id",
        F.round(F.coalesce(F.col("_dcg") / F.col("_ideal"), F.lit(0.0)), 9).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 9).alias("mrr"),
        *[F.round(F.coalesce(F.col(f"_hit_{n}") / F.col("_n"), F.lit(0.0)), 9).alias(f"recall_{n}") for n in recalls],
    )


def summary(per_query: DataFrame, by: str | None = None) -> DataFrame:
    """Means of all metric columns, overall and for each value of ``by`` (null: overall)."""
    names = [c for c in per_query.columns if c not in ("query_id", by)]
    means = [F.round(F.avg(c), 9).alias(c) for c in names]
    if by is None:
        return per_query.agg(*means)
    return per_query.rollup(by).agg(*means)


def first_relevant(run: DataFrame, qrels: DataFrame | Judged) -> DataFrame:
    """query_id, first_rank (null: none found) of every judged query."""
    known = judged(qrels)
    found = known.pairs.join(run, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return known.totals.select("query_id").distinct().join(found, "query_id", "left")


BUCKETS = (1, 5, 10, 20, 50, 100, 500, 1000)


def rank_buckets(run: DataFrame, qrels: DataFrame | Judged, edges: tuple[int, ...] = BUCKETS) -> DataFrame:
    """bucket (its last rank, -1: not found), n, cumulative share of judged queries."""
    bucket = F.lit(-1)
    for e in reversed(edges):
        bucket = F.when(F.col("first_rank") <= e, e).otherwise(bucket)
    counts = first_relevant(run, qrels).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.when(F.col("bucket") < 0, 1 << 30).otherwise(F.col("bucket")))  # a row for each bucket
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("cumulative", F.when(F.col("bucket") > 0, F.round(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total, 9)))


def oracle_ceiling(run: DataFrame, qrels: DataFrame | Judged, depth: int = 100, k: int = 10) -> DataFrame:
    """Per query, the NDCG that the best order of the run's first ``depth`` documents would reach."""
    top = run.where(F.col("rank") <= depth).join(judged(qrels).pairs, ["query_id", "doc_id"])
    best = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).select("query_id", "doc_id", "rank")
    return metrics(best, qrels, k).select("query_id", F.col("ndcg").alias("ceiling"))


def overlap(a: DataFrame, b: DataFrame, qrels: DataFrame | Judged, cuts: list[int]) -> DataFrame:
    """k, both, only_a, only_b, neither, union_rate: judged queries with a relevant document in the first k."""
    spark = a.sparkSession
    ranks = first_relevant(a, qrels).withColumnRenamed("first_rank", "ra").join(first_relevant(b, qrels).withColumnRenamed("first_rank", "rb"), "query_id")
    t = ranks.crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in cuts], "k int")))
    x, y = F.coalesce(F.col("ra") <= F.col("k"), F.lit(False)), F.coalesce(F.col("rb") <= F.col("k"), F.lit(False))
    out = t.groupBy("k").agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    return out.withColumn("union_rate", F.round((F.col("both") + F.col("only_a") + F.col("only_b")) / (F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")), 9))


def lost_by_fusion(fused: DataFrame, singles: list[DataFrame], qrels: DataFrame | Judged, k: int = 10) -> DataFrame:
    """query_id, best_single, fused_rank of the queries that some single run answers in the first k and the fusion does not."""
    best = None
    for s in singles:
        r = first_relevant(s, qrels)
        best = r if best is None else best.unionByName(r)
    best = best.groupBy("query_id").agg(F.min("first_rank").alias("best_single"))
    both = best.join(first_relevant(fused, qrels).withColumnRenamed("first_rank", "fused_rank"), "query_id")
    return both.where((F.col("best_single") <= k) & (F.col("fused_rank").isNull() | (F.col("fused_rank") > k)))


def paired(a: DataFrame, b: DataFrame, metric: str = "ndcg") -> DataFrame:
    """n, mean_delta of b over a, wins, losses, ties."""
    d = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id").select((F.col("y") - F.col("x")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 9).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))


def bootstrap(deltas: DataFrame, group: str, samples: int = 5000, seed: int = 20260923) -> DataFrame:
    """group, mean, low, high: a paired bootstrap of the mean of ``delta`` within each group, with a fixed seed.

    One number per judged query of a group meets in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["delta"].to_numpy())
        rng = np.random.default_rng(seed)
        means = np.sort([x[rng.integers(0, len(x), len(x))].mean() for _ in range(samples)])
        return pd.DataFrame({group: [pdf[group].iloc[0]], "mean": [x.mean()], "low": [means[int(0.025 * samples)]], "high": [means[int(0.975 * samples) - 1]]})

    kind = deltas.schema[group].dataType.simpleString()
    return deltas.select(group, "delta").groupBy(group).applyInPandas(run, f"{group} {kind}, mean double, low double, high double")


def decide(dev: Column, dev_low: Column, conf: Column, conf_low: Column, least: float = 0.005) -> Column:
    """KEEP if the gain is large enough and certain on development and certain on confirmation queries."""
    return F.when((dev >= least) & (dev_low > 0) & (conf > 0) & (conf_low > 0), "KEEP").otherwise("REJECT")


def hash_split(queries: DataFrame, label: str, share: int = 50) -> DataFrame:
    """query_id, part: dev or confirmation by the first 32 bits of sha-256 of label:id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(label + ":"), F.col("query_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return queries.select("query_id", F.when(h % 100 < share, "dev").otherwise("confirmation").alias("part"))


def cross_check(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """query_id, metric, left, right wherever two evaluations of the same queries differ."""
    names = [c for c in a.columns if c != "query_id" and c in b.columns]
    un = lambda d, v: d.unpivot("query_id", names, "metric", v)
    both = un(a, "left").join(un(b, "right"), ["query_id", "metric"], "full_outer")
    return both.where(F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > tolerance))


def percentiles(df: DataFrame, column: str, points: tuple[int, ...] = (50, 90, 95, 99, 100)) -> DataFrame:
    """point and four percentiles of a column with n values: nearest (place round(p (n - 1)), half to even), linear,
    upper (place floor(p n), the last at most) and lower (place floor(p (n - 1))).

    Distinct values are counted first, so only their table is numbered, and only the wanted places are picked.
    """
    spark = df.sparkSession
    known = df.where(F.col(column).isNotNull())
    n = known.count()
    places = [(p, int(round(p / 100 * (n - 1))), min(n - 1, p * n // 100), p * (n - 1) // 100) for p in points] if n else []
    want = spark.createDataFrame([(p, kind, at) for p, *ats in places for kind, at in zip(("nearest", "upper", "lower"), ats, strict=True)], "point int, kind string, at long")
    cum = known.groupBy(column).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))  # distinct values
    hit = cum.join(F.broadcast(want), F.col("upto") > F.col("at")).groupBy("point", "kind").agg(F.min(column).alias("v"))
    picked = hit.groupBy("point").agg(*[F.max(F.when(F.col("kind") == k, F.col("v"))).alias(k) for k in ("nearest", "upper", "lower")])
    lin = df.agg(F.percentile(column, F.array(*[F.lit(p / 100) for p in points])).alias("v")).select(F.posexplode("v").alias("i", "linear"))
    lin = lin.withColumn("point", F.element_at(F.array(*[F.lit(p) for p in points]), F.col("i") + 1))
    return picked.join(lin.select("point", "linear"), "point")


def hard_negatives(run: DataFrame, qrels: DataFrame | Judged, docs: DataFrame, k: int = 20) -> DataFrame:
    """query_id, doc_id, rank: the first k non-relevant documents above the first relevant one, texts distinct."""
    first = first_relevant(run, qrels)
    bad = run.join(judged(qrels).pairs, ["query_id", "doc_id"], "left_anti").join(first, "query_id").where(F.col("first_rank").isNull() | (F.col("rank") < F.col("first_rank")))
    hashed = bad.join(docs.select("doc_id", F.sha2("text", 256).alias("_h")), "doc_id")
    once = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_h").orderBy("rank"))).where("_n = 1")
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_r") <= k).select("query_id", "doc_id", "rank")

