"""Readers of snippet corpora, judgements and runs, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import strip


def resolve(spec: str, known: dict[str, str] | None = None) -> tuple[str, str]:
    """(version, path) of ``name=path``, a known name, or a path, whose stem is then the version."""
    if known and spec in known:
        return spec, known[spec]
    name, sep, path = spec.rpartition("=")
    if sep and name:
        return name, path
    stem = spec.rstrip("/").rsplit("/", 1)[-1]
    return stem.rsplit(".", 1)[0] if "." in stem[1:] else stem, spec


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, at (order of lines within a file) and line of text files."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return lines.where(F.trim("line") != "")


def read_jsonl(spark: SparkSession, path: str, keep_duplicates: bool = False) -> DataFrame:
    """doc_id, text of JSON lines with _id, text and maybe a title.

    Blank lines are skipped and further keys ignored; the text is title, line feed, text without white space at the
    ends.  Of lines with one id the last counts, unless duplicates are kept.  A line without _id or text is an error.
    """
    j = F.from_json("line", "_id string, title string, text string", {"mode": "FAILFAST"})
    rows = _numbered(spark, path).withColumn("j", j)
    bad = F.raise_error(F.concat(F.lit("a line lacks _id or text: "), F.substring("line", 1, 80))).cast("string")
    ok = F.col("j._id").isNotNull() & F.col("j.text").isNotNull()
    rows = rows.select("at", F.when(ok, F.col("j._id")).otherwise(bad).alias("doc_id"), strip(F.concat(F.coalesce("j.title", F.lit("")), F.lit("\n"), F.col("j.text"))).alias("text"))
    if keep_duplicates:
        return rows.drop("at")
    return rows.groupBy("doc_id").agg(F.max_by("text", "at").alias("text"))


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus: doc_id, text; queries: query_id, text; qrels: query_id, doc_id, grade).

    Judgements of 0 or less are dropped; one that names an unknown query or document is an error as it is read.
    """
    corpus = read_jsonl(spark, f"{folder}/corpus.jsonl")
    queries = read_jsonl(spark, f"{folder}/queries.jsonl").withColumnRenamed("doc_id", "query_id")
    raw = spark.read.option("sep", "\t").option("header", True).schema("query_id string, doc_id string, score int").csv(f"{folder}/qrels/{split}.tsv")
    good = raw.where("score > 0").select("query_id", "doc_id", F.col("score").alias("grade"))
    known = good.join(corpus.select("doc_id", F.lit(1).alias("_d")), "doc_id", "left").join(queries.select("query_id", F.lit(1).alias("_q")), "query_id", "left")
    error = F.raise_error(F.concat(F.lit("judgement of an unknown id: "), "query_id", F.lit(" "), "doc_id")).cast("string")
    return corpus, queries, known.select(F.when(F.col("_d").isNotNull() & F.col("_q").isNotNull(), F.col("query_id")).otherwise(error).alias("query_id"), "doc_id", "grade")


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade of lines ``query 0 document grade``."""
    p = F.split(F.trim("line"), r"\s+")
    return _numbered(spark, path).select(p[0].alias("query_id"), p[2].alias("doc_id"), p[3].cast("int").alias("grade"))


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, rank, score, tag of lines ``query Q0 document rank score tag``; the order is the rank's."""
    p = F.split(F.trim("line"), r"\s+")
    return _numbered(spark, path).select(p[0].alias("query_id"), p[2].alias("doc_id"), p[3].cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"))


def _checked(ids: str) -> F.Column:
    return F.when(F.col(ids).rlike(r"^\S+$"), F.col(ids)).otherwise(F.raise_error(F.concat(F.lit("an id holds white space: "), F.col(ids))).cast("string"))


def write_trec_run(run: DataFrame, path: str, tag: str = "sparkloom") -> None:
    """Writes a run (query_id, doc_id, rank); scores fall from the list's length to 1.  Repeated documents and ids with
    white space are errors."""
    q = Window.partitionBy("query_id")
    n = F.count("*").over(Window.partitionBy("query_id", "doc_id"))
    rows = run.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), "rank")
    rows = rows.withColumn("rank", F.row_number().over(q.orderBy("rank"))).withColumn("score", F.count("*").over(q) - F.col("rank") + 1)
    doc = F.when(n == 1, _checked("doc_id")).otherwise(F.raise_error(F.lit("a document is ranked twice")).cast("string"))
    line = F.concat_ws(" ", _checked("query_id"), F.lit("Q0"), doc, "rank", "score", F.lit(tag))
    rows.select("query_id", "rank", line.alias("value")).orderBy("query_id", "rank").select("value").write.mode("errorifexists").text(path)


def write_trec_qrels(qrels: DataFrame, path: str) -> None:
    """Writes judgements in order of queries and documents."""
    rows = qrels.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), "grade")
    rows.orderBy("query_id", "doc_id").select(F.concat_ws(" ", _checked("query_id"), F.lit("0"), _checked("doc_id"), "grade").alias("value")).write.mode("errorifexists").text(path)


def pack_ranks(run: DataFrame) -> DataFrame:
    """query_id, docs (ids in order, joined by spaces), sha256 of each list."""
    docs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))), lambda x: x["d"]), " ")
    return run.groupBy("query_id").agg(docs.alias("docs")).withColumn("sha256", F.sha2("docs", 256))


def write_packed(run: DataFrame, path: str) -> None:
    """Packed ranks as compressed text, a query a line."""
    pack_ranks(run).select(F.concat_ws("\t", "query_id", "docs").alias("value")).write.option("compression", "gzip").text(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, rank of packed ranks."""
    p = F.split("line", "\t")
    return _numbered(spark, path).select(p[0].alias("query_id"), F.posexplode(F.split(p[1], " ")).alias("i", "doc_id")).select("query_id", "doc_id", (F.col("i") + 1).alias("rank"))


def dataset_report(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: counts, duplicate ids, judgements of unknown ids."""
    dup = docs.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("duplicate_ids"))
    bad = qrels.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("dangling_documents"))
    badq = qrels.join(queries.select("query_id").distinct(), "query_id", "left_anti").agg(F.count("*").alias("dangling_queries"))
    return docs.agg(F.count("*").alias("documents")).crossJoin(queries.agg(F.count("*").alias("queries"))).crossJoin(dup).crossJoin(bad).crossJoin(badq)  # one row each


def check_packed(packed: DataFrame) -> DataFrame:
    """query_id of the packed rankings (query_id, docs, sha256) whose list does not have its digest; none if all are sound."""
    return packed.where(F.col("sha256").isNull() | (F.sha2("docs", 256) != F.col("sha256"))).select("query_id")


def vector_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, vector of Parquet shards, aligned by id and never by place; an id in two shards is an error as it is read."""
    rows = spark.read.parquet(*paths).select("doc_id", "vector")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return rows.withColumn("_n", n).withColumn("vector", F.when(F.col("_n") == 1, F.col("vector")).otherwise(F.raise_error(F.lit("an id is in two shards")))).drop("_n")


def write_evidence(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; one of more than ``most`` rows is an error, as a report is read by people."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines_ = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines_ + ["| " + " | ".join(map(cell, r)) + " |" for r in got]) + "\n"
