"""What went wrong and which setting to take: comparisons of runs, error rows, gates, sweeps, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import generic_tokens
from sparkloom.operators._size import small
from sparkloom.operators.evaluation import Judged, first_relevant

#: A rank that stands for "not found".
NOWHERE = 1 << 30


def ranks_of(runs: dict[str, DataFrame], qrels: DataFrame | Judged) -> DataFrame:
    """query_id and the first relevant rank of each named run (null: none), one row per judged query."""
    out = None
    for name, run in runs.items():
        one = first_relevant(run, qrels).withColumnRenamed("first_rank", name)
        out = one if out is None else out.join(one, "query_id")
    return out


def head_to_head(ranks: DataFrame, a: str, b: str, fused: str) -> DataFrame:
    """One row: how often a run ranks a relevant document higher than another, and how their fusion fares."""
    x, y, z = [F.coalesce(F.col(c), F.lit(NOWHERE)) for c in (a, b, fused)]
    best = F.least(x, y)
    return ranks.agg(
        F.count_if(x < y).alias("a_higher"), F.count_if(y < x).alias("b_higher"), F.count_if(x == y).alias("same"), F.count_if(z < best).alias("fused_beats_both"),
        F.count_if(z > best).alias("fused_below_best"), F.count_if(F.least(best, z) > 100).alias("all_miss_100"),
    )


def mode_comparison(per: DataFrame, a: str, b: str, fused: str) -> DataFrame:
    """One row of counts over per-query scores in the columns a, b and fused."""
    x, y, z = F.col(a), F.col(b), F.col(fused)
    top = F.greatest(x, y, z)
    won = lambda c: F.count_if((c > 0) & (c == top))
    return per.agg(
        F.count_if(top == 0).alias("all_zero"), F.count_if((x > 0) & (y == 0)).alias("a_only"), F.count_if((y > 0) & (x == 0)).alias("b_only"), F.count_if((x > 0) & (y > 0)).alias("both"),
        F.count_if(z > F.greatest(x, y)).alias("fused_beats_both"), F.count_if(z < x).alias("fused_below_a"), F.count_if(z < y).alias("fused_below_b"),
        won(x).alias("a_best"), won(y).alias("b_best"), won(z).alias("fused_best"),
    )


def bottleneck(problems: Column, ceiling: Column, union_gain: Column, target: float = 0.2, least_gain: float = 0.03) -> Column:
    """Where the next gain lies: in the measurement, the candidates, the fusion or the ranking."""
    # fixed values: the target, the least gain and the names
    return F.when(problems > 0, "MEASUREMENT").when(ceiling < target, "CANDIDATE RETRIEVAL").when(union_gain >= least_gain, "FUSION").otherwise("RANKING")


def failures(ranks: DataFrame, a: str, b: str, fused: str, depth: int = 10, reach: int = 100) -> DataFrame:
    """query_id, category of the queries whose relevant document the fusion does not bring among the first ``depth``."""
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    category = F.when(within(fused, reach), "ranked too low").when(within(a, reach) | within(b, reach), "lost by fusion").otherwise("not retrieved")
    return ranks.where(~within(fused, depth)).select("query_id", category.alias("category"))


def vocabulary_overlap(queries: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, doc_id, query_terms_in_doc, doc_terms_in_query: shares of the distinct generic tokens of either side."""
    rows = pairs.select("query_id", "doc_id").join(small(queries.select("query_id", "query")), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.select("query_id", "doc_id", F.array_distinct(generic_tokens(F.col("query"))).alias("q"), F.array_distinct(generic_tokens(F.col("text"))).alias("d"))
    part = lambda side: F.round(F.size(F.array_intersect("q", "d")) / F.greatest(F.lit(1), F.size(side)), 3)
    return rows.select("query_id", "doc_id", part("q").alias("query_terms_in_doc"), part("d").alias("doc_terms_in_query"))


def error_rows(run: DataFrame, qrels: DataFrame | Judged, queries: DataFrame, docs: DataFrame, depth: int = 10, positives: DataFrame | None = None) -> DataFrame:
    """Judged queries without a relevant document among the first ``depth``: query_id, first_rank, positive (its smallest
    id of the best grade), n_negatives among the first, and whether the first one has more words of the query.

    ``positives`` (query_id, positive) is asked for where the judgements are only those of the run's documents."""
    good = positives if positives is not None else qrels.where("grade > 0").groupBy("query_id").agg(F.min(F.struct(-F.col("grade"), F.col("doc_id")))["doc_id"].alias("positive"))
    bad = first_relevant(run, qrels).where(F.col("first_rank").isNull() | (F.col("first_rank") > depth))
    top = run.where(F.col("rank") <= depth).groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("top"), F.count("*").alias("n_negatives"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    text = lambda name: docs.select(F.col("doc_id").alias(name), words(F.col("text")).alias(f"{name}_words"))
    rows = bad.join(good, "query_id").join(top, "query_id", "left").join(small(queries.select("query_id", words(F.col("query")).alias("words"))), "query_id")
    rows = rows.join(text("positive"), "positive", "left").join(text("top"), "top", "left")
    hits = lambda c: F.coalesce(F.size(F.array_intersect("words", c)), F.lit(0))
    return rows.select("query_id", "first_rank", "positive", F.coalesce("n_negatives", F.lit(0)).alias("n_negatives"), (hits("top_words") > hits("positive_words")).alias("top_has_more_words"))


def gate_thresholds(rows: DataFrame, quantiles: tuple[float, ...] = (5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95)) -> DataFrame:
    """measure, quantile, threshold: linear percentiles of the margins (query_id, measure, margin, ...)."""
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    got = rows.groupBy("measure").agg(F.percentile("margin", F.array(*[F.lit(q / 100) for q in quantiles])).alias("t"))
    return got.select("measure", F.explode(F.arrays_zip(points.alias("quantile"), F.col("t").alias("threshold"))).alias("z")).select("measure", "z.quantile", "z.threshold")


def gate_sweep(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """What a gate at each threshold would do, a row each, in one job.

    ``rows``: query_id, measure, margin, old_rank, new_rank of the one relevant document.  A gate takes the new rank
    where the margin is at most the threshold.  It is eligible if it avoids half of the harm and keeps half of the gain.
    """
    both = rows.join(small(thresholds), "measure")
    hit, better, worse = F.col("margin") <= F.col("threshold"), F.col("new_rank") < F.col("old_rank"), F.col("new_rank") > F.col("old_rank")
    rank = F.when(hit, F.col("new_rank")).otherwise(F.col("old_rank"))
    ndcg = F.when(rank <= 10, 1 / F.log2(rank + 1.0)).otherwise(0.0)
    out = both.groupBy("measure", "quantile", "threshold").agg(
        F.count_if(hit).alias("gated"), F.count_if(better).alias("gains"), F.count_if(worse).alias("harms"), F.count_if(better & hit).alias("gains_kept"), F.count_if(worse & ~hit).alias("harms_avoided"),
        F.round(F.avg(ndcg), 9).alias("ndcg"), F.round(F.avg(F.when(rank <= 10, 1 / rank).otherwise(0.0)), 9).alias("mrr"),
    )
    ok = (F.col("harms") > 0) & (2 * F.col("harms_avoided") >= F.col("harms")) & (F.col("gains") > 0) & (2 * F.col("gains_kept") >= F.col("gains"))
    return out.withColumn("eligible", ok)


def choose_gate(sweep: DataFrame) -> DataFrame:
    """The eligible gate of the best NDCG, then MRR, then fewest gated queries, then smallest measure; no row if there is none."""
    return sweep.where("eligible").orderBy(F.desc("ndcg"), F.desc("mrr"), "gated", "measure", "threshold").limit(1)


def best_settings(sweep: DataFrame, settings: list[str], metrics: list[str]) -> DataFrame:
    """metric and the setting columns of the best row by each metric; ties go to the smallest setting."""
    setting = F.struct(*settings)
    one = lambda m: F.struct(F.lit(m).alias("metric"), F.min_by(setting, F.struct(-F.col(m), setting)).alias("s"), F.max(m).alias("value"))
    got = sweep.agg(F.array(*[one(m) for m in metrics]).alias("a")).select(F.explode("a").alias("b"))
    return got.select("b.metric", "b.s.*", "b.value").where("value is not null")


def standardisation(rows: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean, scale: population deviations, 1 for a constant feature."""
    long = rows.unpivot([], names, "feature", "x")
    return long.groupBy("feature").agg(F.avg("x").alias("mean"), F.when(F.stddev_pop("x") > 0, F.stddev_pop("x")).otherwise(F.lit(1.0)).alias("scale"))


def ranking_checks(run: DataFrame, docs: DataFrame, judged: DataFrame, depth: int) -> DataFrame:
    """One row: queries, mean_depth, missing_queries, repeated, too_deep, unknown_documents; the last four are 0 in a sound run."""
    per = run.groupBy("query_id").agg(F.count("*").alias("n"))
    unknown = run.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("unknown_documents"))
    return run_checks(per, run, unknown, judged, depth)


def run_checks(per: DataFrame, again: DataFrame, unknown: DataFrame, judged: DataFrame, depth: int) -> DataFrame:
    """The row of ``ranking_checks`` from what its counts need: query_id and n of every query, all rows of a run that could
    be repeated, and the one row of unknown_documents."""
    again = again.groupBy("query_id", "doc_id").count().where("count > 1").agg(F.count("*").alias("repeated"))
    missing = judged.select("query_id").distinct().join(per, "query_id", "left_anti").agg(F.count("*").alias("missing_queries"))
    base = per.agg(F.count("*").alias("queries"), F.round(F.avg("n"), 9).alias("mean_depth"), F.count_if(F.col("n") > depth).alias("too_deep"))
    return base.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(again)).crossJoin(F.broadcast(unknown))  # one row each


def stratum(text: Column) -> Column:
    """Whether a program is given as a class to fill in or reads its input itself."""
    return F.when(F.contains(text, F.lit("class Solution")), "starter").otherwise("stdin")


def hash_sample(rows: DataFrame, label: str, n: int, by: str | None = None, key: str = "query_id") -> DataFrame:
    """The ``n`` rows (of each value of ``by``) that come first by sha-256 of label and key: a sample that any run repeats."""
    order = F.sha2(F.concat(F.lit(label + ":"), F.col(key).cast("string")), 256)
    if by is None:
        return rows.orderBy(order, key).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("_n") <= n).drop("_n")


def by_length(texts: DataFrame, text: str = "text", parts: int | None = None) -> DataFrame:
    """The rows dealt to partitions by the length of their text and sorted in them, so that batches need little padding."""
    n = F.coalesce(F.length(text), F.lit(0))
    dealt = texts.repartitionByRange(parts, n) if parts else texts.repartitionByRange(n)
    return dealt.sortWithinPartitions(n)
