"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; the smallest keys of a source come first.
A source's target is reached by complete epochs and then by a prefix, in key order, of one more epoch.  Prefix
sums run over key cells of each source, then over the parts of the one cell in which the target falls, then over the
rows of one part, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm._common import WORD, discard, pick, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKETS = 1024
#: Up to so many sources, their table is broadcast; beyond it, the join is salted.
BROADCAST_SOURCES = 50_000
SALTS = 16
#: Up to so many labelled documents, their labels are broadcast.
BROADCAST_LABELS = 1_000_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes.  A target
    stops at ``max_epochs`` times its source; the excess goes to the others by weight until none is above.  That
    is water filling: in order of size / weight the capped sources come first, so one prefix sum finds the level.
    """
    ranked = sources.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_n").asc())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        ranked.withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.col("_cap_before")) / (F.sum("_w").over(everything) - F.col("_w_before")))
        .withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn("_level", F.min_by("_level", F.when(F.col("_fits"), F.col("_w_before"))).over(everything))
    )
    target = F.coalesce(F.least(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def rated(rows: DataFrame, labels: DataFrame | None, id_: str, seed: str = "mix") -> DataFrame:
    """``rows`` with ``_key``, the exponential key of the document, and ``_place``, the cell of its rank among all keys.

    The keys come from md5 of seed and doc_id (column ``id_``) and from the quality of the labels, and from nothing else.
    """
    q = F.lit(1.0)
    if labels is not None:
        best = pick(labels, "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("_quality")).where("doc_id is not null and _quality is not null").withColumnRenamed("doc_id", "_labelled")
        few = best.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
        rows = rows.join(F.broadcast(best) if few else best, F.col(id_) == F.col("_labelled"), "left")
        q = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_).cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    cells = BUCKETS * BUCKETS
    rows = rows.withColumn("_key", -F.log(u) / q)
    return rows.withColumn("_place", F.least(F.floor((1 - F.exp(-F.col("_key"))) * cells), F.lit(cells - 1)).cast("long")).drop("_quality", "_labelled")


def _edge(cells: DataFrame, aims: DataFrame) -> DataFrame:
    """The cell of each source in which its remainder falls, and the words before it, from (source, cell, words).

    ``aims`` has _s, _rest and _start, the words before the first of these cells.
    """
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    both = cells.withColumn("_sum", F.coalesce(F.sum("words").over(before), F.lit(0))).join(aims, F.col("source").eqNullSafe(F.col("_s")))
    both = both.withColumn("_sum", F.col("_sum") + F.col("_start"))
    return both.where((F.col("_sum") < F.col("_rest")) & (F.col("_sum") + F.col("words") >= F.col("_rest"))).select("_s", "_rest", F.col("cell").alias("_cell"), F.col("_sum").alias("_start"))


def cuts(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A written table, one row per source of ``base`` (doc_id, source, size, _key, _place): _s, source_size, target, the
    complete epochs, and the last document (key, doc_id, size) that one more epoch still takes.

    The remainder is found among BUCKETS cells of a source, then among the BUCKETS parts of that cell, then among the
    rows of one part, so no task sorts more than a millionth of a source.
    """
    cells = base.groupBy("source", F.floor(F.col("_place") / BUCKETS).alias("cell")).agg(F.sum("size").alias("words"))
    cells = written(cells, "cells")  # at most BUCKETS rows a source
    aims = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    aims = aims.withColumn("_epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("int"))
    aims = aims.withColumn("_rest", F.when(F.col("_epochs") < max_epochs, F.col("target") - F.col("_epochs") * F.col("source_size")).otherwise(0.0))
    aims = written(aims.withColumnRenamed("source", "_s"), "aims")
    one = written(_edge(cells, aims.select("_s", "_rest", F.lit(0).alias("_start"))), "edges")  # a row per source
    hint = F.broadcast if one.count() <= BROADCAST_SOURCES else (lambda df: df)
    inner = base.join(hint(one.drop("_rest", "_start")), F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("_place") / BUCKETS) == F.col("_cell"))).drop("_s", "_cell")
    inner = written(inner, "inner")
    two = written(_edge(inner.groupBy("source", F.col("_place").alias("cell")).agg(F.sum("size").alias("words")), one.select("_s", "_rest", "_start")), "parts")
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = inner.join(hint(two), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_place") == F.col("_cell"))).withColumn("_sum", F.col("_start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = F.col("_sum") + F.col("size") <= F.col("_rest")
    nearer = (F.col("_sum") < F.col("_rest")) & (F.col("_rest") - F.col("_sum") > F.col("_sum") + F.col("size") - F.col("_rest"))
    last = rows.where(fits | nearer).groupBy(F.col("source").alias("_l")).agg(F.max(F.struct("_key", "doc_id", "size")).alias("_last"))
    # without a last document, all before the part are taken; without a part (rounding), all of the source
    place = two.select(F.col("_s").alias("_p"), F.col("_cell").alias("_part"))
    plan = aims.join(place, F.col("_s").eqNullSafe(F.col("_p")), "left").join(last, F.col("_s").eqNullSafe(F.col("_l")), "left").drop("_p", "_l")
    plan = written(plan, "plan")
    discard(cells, aims, one, inner, two)
    return plan


def with_copies(rows: DataFrame, plan: DataFrame, id_: str, source: str, size: F.Column, some: F.Column) -> DataFrame:
    """``rows`` (rated) with the columns of their source's plan and ``copies``: how often the mix holds the row.

    ``some`` says whether the document has words at all; ``size`` is looked at only for the last document taken.
    """
    if plan.count() <= BROADCAST_SOURCES:
        full = rows.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col("_s")))
    else:
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = rows.withColumn("_own", F.pmod(F.xxhash64(id_, "_key"), F.lit(SALTS)).cast("int"))
        full = left.join(salted, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_own") == F.col("_salt"))).drop("_salt", "_own")
    key, at, last = F.col("_key"), F.col("_place"), F.col("_last")
    id_null = F.struct(F.col(id_)) < F.struct(last["doc_id"])  # structs order nulls first, as the windows do
    in_part = F.when(last.isNull() | (key > last["_key"]), False).when((key < last["_key"]) | id_null, True).when(F.col(id_).eqNullSafe(last["doc_id"]), size <= last["size"]).otherwise(False)
    more = F.when(F.col("_rest") <= 0, False).when(F.col("_part").isNull() | (at < F.col("_part")), True).when(at > F.col("_part"), False).otherwise(in_part)
    return full.withColumn("copies", F.when(some, F.col("_epochs") + more.cast("int")).otherwise(0).cast("int"))


def mix(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (int), taken.

    ``docs`` needs doc_id, text and source.  Size is the number of words.  ``copies`` says how often the mix holds
    the document, at most ``max_epochs`` times; taken = copies * size.  The keys come from md5 of seed and doc_id,
    so reruns and other partitionings agree.  ``labels`` (doc_id, quality), if given, makes quality 1 twice and
    quality 0 half as likely to come early; unlabelled documents weigh 1; of several labels the best counts.

    Edge cases: null or empty text has size 0, is never taken and changes nothing; a null source is a source of its
    own, last in order; a null doc_id hashes like an empty string; repeated rows each count, ties are broken by
    doc_id and size, and rows that tie with the last document taken are all taken; an empty table gives an empty
    result.  The document that crosses the remainder is taken if that comes nearer to the target.
    """
    base = pick(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = written(rated(base, labels, "doc_id", seed), "sizes")
    full = with_copies(base, cuts(base, weights, max_epochs), "doc_id", "source", F.col("size"), F.col("size") > 0)
    return full.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` holds it; texts do not move for it.

    The table of what a source takes is small, and a row's key is a function of its doc_id and label, so every row
    tells by itself how often it is taken.
    """
    base = pick(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = written(rated(base, labels, "doc_id", seed), "sizes")
    plan = cuts(base, weights, max_epochs)
    discard(base)
    names = docs.columns
    id_, text, source = [f"_c{names.index(n)}" for n in ("doc_id", "text", "source")]
    rows = rated(docs.toDF(*[f"_c{i}" for i in range(len(names))]), labels, id_, seed)
    full = with_copies(rows, plan, id_, source, F.regexp_count(text, F.lit(WORD)), F.coalesce(F.col(text).rlike(WORD), F.lit(False))).where("copies > 0")
    return full.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / CASE b.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM src),
w AS (SELECT *, (n - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM ranked),
lv AS (
  SELECT *, coalesce(sum(w) OVER l, 0) AS wb,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER l, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER l, 0))::DOUBLE AS level
  FROM w WINDOW l AS (ORDER BY cap::DOUBLE / w::DOUBLE, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aim AS (
  SELECT source, source_size,
    coalesce(least((SELECT min_by(level, wb) FROM lv WHERE level * w <= cap) * w, cap::DOUBLE), cap::DOUBLE) AS target FROM lv),
part AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM aim),
rest AS (SELECT *, CASE WHEN epochs < 3 THEN target - epochs * source_size ELSE 0 END AS rest FROM part),
cum AS (
  SELECT b.doc_id, b.size, r.source_size, r.target, r.epochs, r.rest,
    coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM base b JOIN rest r ON b.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN s + size <= rest OR (s < rest AND rest - s > s + size - rest) THEN 1 ELSE 0 END)::BIGINT END::BIGINT AS taken
FROM cum
"""
