"""BM25 with a title field over code tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import code_tokens
from sparkloom.operators._size import saved, small
from sparkloom.settings import DEFAULT


@dataclass
class LexicalIndex:
    """tf: doc_id, term, tf, len, written once; stats: n_docs, avg_len; titles: doc_id, term (distinct)."""

    tf: DataFrame
    stats: DataFrame
    titles: DataFrame | None = None

    def weights(self, terms: DataFrame | None = None) -> DataFrame:
        """term, df, idf of all terms, or of those in ``terms`` (term, distinct)."""
        tf = self.tf if terms is None else self.tf.join(terms, "term", "left_semi")
        df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.stats.select("n_docs")))  # stats is one row
        return df.select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def hits(self, terms: DataFrame) -> DataFrame:
        """The postings of query terms (query_id, term, times), with idf, n_docs and avg_len.

        Only postings of query terms leave the scan: the terms, if few, are broadcast to it.  They are dealt by document
        before queries meet them, so that what is summed for a query and a document needs no shuffle of its own.
        """
        asked = small(terms.select("term").distinct())
        weighted = small(terms.join(small(self.weights(asked)), "term"))
        tf = self.tf.join(asked, "term", "left_semi").repartition("doc_id")
        return tf.join(weighted, "term").crossJoin(F.broadcast(self.stats))  # stats is one row


def build(docs: DataFrame, tokens=code_tokens, text: str = "text", title: str | None = None) -> LexicalIndex:
    """The index of ``docs`` (doc_id, text and maybe a title).  A text without tokens counts one ``__empty__``.

    Texts are read and cut into tokens once; everything else comes from the table of term frequencies.
    """
    some = F.when(F.size("_t") == 0, F.array(F.lit("__empty__"))).otherwise(F.col("_t"))
    toks = docs.select("doc_id", tokens(F.col(text)).alias("_t")).withColumn("_t", some)
    tf = saved(toks.select("doc_id", F.size("_t").alias("len"), F.explode("_t").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")))
    stats = saved(tf.agg(F.sum("tf").alias("_all")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs")))).select("n_docs", (F.col("_all") / F.col("n_docs")).alias("avg_len")))  # one row
    titles = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col(title)))).alias("term")) if title else None
    return LexicalIndex(tf, stats, titles)


def query_terms(queries: DataFrame, tokens=code_tokens) -> DataFrame:
    """query_id, term, times: repeated terms count repeatedly."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def scores(index: LexicalIndex, queries: DataFrame, k1: float = DEFAULT.k1, b: float = DEFAULT.b, tokens=code_tokens, title_weight: float = DEFAULT.title_weight, text_weight: float = DEFAULT.text_weight) -> DataFrame:
    """query_id, doc_id, score > 0, rounded to nine places so that equal sums tie whatever their order."""
    terms = query_terms(queries, tokens)
    impact = F.col("idf") * F.col("tf") * (F.lit(k1) + 1) / (F.col("tf") + F.lit(k1) * (1 - F.lit(b) + F.lit(b) * F.col("len") / F.col("avg_len")))
    parts = index.hits(terms).select("query_id", "doc_id", (F.lit(text_weight) * impact * F.col("times")).alias("s"))
    if index.titles is not None:
        idf = small(index.weights(small(terms.select("term").distinct())))
        titled = index.titles.join(small(terms.join(idf, "term")), "term")
        parts = parts.unionByName(titled.select("query_id", "doc_id", (F.lit(title_weight) * F.col("idf") * F.col("times")).alias("s")))
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score")).where("score > 0")


def ranked(scored: DataFrame, k: int, by: str = "query_id", index: str | None = None) -> DataFrame:
    """The k best of each query with their ranks from 1: by score, then by doc_id as text, or by a column that numbers
    the documents as a stable sort of them would."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.col("doc_id").cast("string") if index is None else F.col(index))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grid(index: LexicalIndex, queries: DataFrame, settings: list[tuple[float, float]], tokens=code_tokens) -> DataFrame:
    """k1, b, query_id, doc_id, score for all settings in one job: a sum a setting, so postings are read and grouped once."""
    hits = index.hits(query_terms(queries, tokens))

    def score(k1: float, b: float) -> Column:
        norm = F.lit(k1) * (1 - F.lit(b) + F.lit(b) * F.col("len") / F.col("avg_len"))
        return F.round(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (F.lit(k1) + 1) / (F.col("tf") + norm)), 9)

    sums = hits.groupBy("query_id", "doc_id").agg(*[score(float(k1), float(b)).alias(f"s{i}") for i, (k1, b) in enumerate(settings)])
    rows = F.array(*[F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), F.col(f"s{i}").alias("score")) for i, (k1, b) in enumerate(settings)])
    return sums.select("query_id", "doc_id", F.explode(rows).alias("r")).select("r.k1", "r.b", "query_id", "doc_id", "r.score").where("score > 0")


def build_without_stop_words(docs: DataFrame, text: str = "text", title: str | None = None) -> tuple[LexicalIndex, Callable]:
    """An index that keeps stop words, and the tokenizer that queries need for it: what an ablation compares with."""
    tokens = lambda c: code_tokens(c, ())
    return build(docs, tokens, text, title), tokens


def rank_of(scored: DataFrame, wanted: DataFrame, index: str = "index") -> DataFrame:
    """query_id, doc_id, rank of one document of each query (query_id, doc_id): the scores (query_id, doc_id, score, index)
    above its own, and equal ones of a smaller index, plus one.  Nothing is sorted."""
    own = scored.join(wanted.select("query_id", "doc_id"), ["query_id", "doc_id"]).select("query_id", F.col("doc_id").alias("_d"), F.col("score").alias("_s"), F.col(index).alias("_i"))
    both = scored.join(small(own), "query_id")
    before = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col(index) < F.col("_i")))
    return both.groupBy("query_id", F.col("_d").alias("doc_id")).agg((F.count_if(before) + 1).cast("int").alias("rank"))
