"""Stored indexes, names and vectors: immutable versions in Parquet, renamed into place when complete."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save_index(tables: dict[str, DataFrame], folder: str, version_key: str, manifest: dict) -> None:
    """Writes every table of a version and its manifest into a folder of its own, then renames that to the version's.

    Readers see all of a version or nothing; what a failed attempt leaves behind is in nobody's way.  A version that
    exists is left as it is and is an error.
    """
    spark = next(iter(tables.values())).sparkSession
    staging = f"{folder}/staging-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    row = [(version_key, json.dumps(manifest, sort_keys=True), ",".join(sorted(tables)))]
    spark.createDataFrame(row, "version_key string, manifest string, tables string").withColumn("indexed_at", F.current_timestamp()).write.parquet(f"{staging}/manifest")
    fs, done = _folder(spark, f"{folder}/{version_key}")
    if fs.exists(done) or not fs.rename(_folder(spark, staging)[1], done):
        fs.delete(_folder(spark, staging)[1], True)
        raise FileExistsError(f"version {version_key} is stored already")


def stored(spark: SparkSession, folder: str, version_key: str) -> bool:
    """Whether a version is there."""
    fs, at = _folder(spark, f"{folder}/{version_key}/manifest")
    return fs.exists(at)


def load_index(spark: SparkSession, folder: str, version_key: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, manifest) of a version; vectors must be those of the chunks, of one length and finite."""
    row = spark.read.parquet(f"{folder}/{version_key}/manifest").first()
    tables = {n: spark.read.parquet(f"{folder}/{version_key}/{n}") for n in row["tables"].split(",")}
    if {"chunks", "vectors"} <= tables.keys():
        a, b = tables["chunks"].select("doc_id"), tables["vectors"].select("doc_id")
        if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
            raise ValueError("chunks and vectors disagree")
        v = F.col("vector")
        odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        shape = tables["vectors"].agg(F.count_distinct(F.size(v)).alias("sizes"), F.count_if(v.isNull() | odd).alias("bad")).first()
        if shape["sizes"] > 1 or shape["bad"]:
            raise ValueError("vectors differ in length or are not finite")
    return tables, json.loads(row["manifest"])


def put_alias(spark: SparkSession, folder: str, repo: str, version: str, version_key: str) -> None:
    """Lets a name of a repository stand for a version; later rows replace earlier ones."""
    spark.createDataFrame([(repo, version, version_key)], "repo string, version string, version_key string").withColumn("set_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/aliases")


def aliases(spark: SparkSession, folder: str) -> DataFrame:
    """repo, version, version_key, set_at: what every name stands for now."""
    fs, at = _folder(spark, f"{folder}/aliases")
    if not fs.exists(at):
        return spark.createDataFrame([], "repo string, version string, version_key string, set_at timestamp")
    last = F.row_number().over(Window.partitionBy("repo", "version").orderBy(F.desc("set_at")))
    return spark.read.parquet(f"{folder}/aliases").withColumn("_n", last).where("_n = 1").drop("_n")


def alias(spark: SparkSession, folder: str, repo: str, version: str) -> str | None:
    """The key that a name stands for."""
    row = aliases(spark, folder).where((F.col("repo") == repo) & (F.col("version") == version)).first()
    return row["version_key"] if row else None


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The vectors kept at a path (model, text_hash, vector, written_at); none where nothing was kept."""
    fs, at = _folder(spark, path)
    return spark.read.parquet(path) if fs.exists(at) else spark.createDataFrame([], "model string, text_hash string, vector array<float>, written_at timestamp")


def published(chunks: DataFrame, cache_: DataFrame, published_: DataFrame, model: str, encoder, least_missing: int = 256, n: int = 8) -> DataFrame:
    """The published vectors (text_hash, vector) to add to a cache: those of missing texts, if at least ``least_missing``
    are missing and ``n`` of them agree with freshly encoded ones; else none."""
    from sparkloom.operators.dense import encode

    missing = missing_vectors(chunks, cache_, model)
    known = missing.join(published_.select("text_hash", "vector"), "text_hash")
    none = known.select("text_hash", "vector").limit(0)
    if missing.limit(least_missing).count() < least_missing:
        return none
    some = known.orderBy("text_hash").limit(n)
    live = encode(some.select("text_hash", "text"), encoder)
    return known.select("text_hash", "vector") if probe(some, live).first()["accepted"] else none


def missing_vectors(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The distinct texts (text_hash, text) that the cache (model, text_hash, vector) lacks."""
    known = cache.where(F.col("model") == model).select("text_hash")
    return chunks.select("text_hash", "text").dropDuplicates(["text_hash"]).join(known, "text_hash", "left_anti")


def with_vectors(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Chunks with the vectors that the cache holds for them, by content and never by position."""
    return chunks.join(latest(cache).where(F.col("model") == model).select("text_hash", "vector"), "text_hash", "left")


def latest(cache: DataFrame) -> DataFrame:
    """One row for each (model, text_hash): that written last."""
    if "written_at" not in cache.columns:
        return cache.dropDuplicates(["model", "text_hash"])
    n = F.row_number().over(Window.partitionBy("model", "text_hash").orderBy(F.desc("written_at")))
    return cache.withColumn("_n", n).where("_n = 1").drop("_n")


def put_vectors(vectors: DataFrame, path: str) -> None:
    """Appends vectors (model, text_hash, vector) to a cache; later rows replace earlier ones when read by ``latest``."""
    vectors.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def probe(published: DataFrame, live: DataFrame, least: float = 0.995) -> DataFrame:
    """One row: n, worst, accepted: whether stored vectors agree with freshly encoded ones of the same texts."""
    from sparkloom.functions.vectors import dot

    both = published.select("text_hash", F.col("vector").alias("a")).join(live.select("text_hash", F.col("vector").alias("b")), "text_hash")
    return both.agg(F.count("*").alias("n"), F.min(dot(F.col("a"), F.col("b"))).alias("worst")).withColumn("accepted", F.coalesce(F.col("worst") >= least, F.lit(False)))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids in both, worst cosine, identical vectors, of two vector tables (doc_id, vector)."""
    from sparkloom.functions.vectors import dot, norm

    both = a.select("doc_id", F.col("vector").alias("x")).join(b.select("doc_id", F.col("vector").alias("y")), "doc_id")
    c = dot(F.col("x"), F.col("y")) / F.greatest(norm(F.col("x")) * norm(F.col("y")), F.lit(1e-300))
    return both.agg(F.count("*").alias("n"), F.min(c).alias("worst_cosine"), F.count_if(F.col("x") == F.col("y")).alias("identical"))
