"""A training-data pipeline over ``documents``: five stages, each one operator of sparkloom.llm.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_codec
from sparkloom.llm._common import discard, drop_rows, held_out, pick, written

#: A document stays if a language was found with at least this posterior probability.
LEAST_SCORE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language the model cannot tell; the others stay as they are.

    Every row is judged by its own text: null text goes, a null doc_id, repeated rows and further columns of any name
    make no difference, an empty table stays empty.
    """
    model = language_id.train(pick(docs, "doc_id", "text", "lang").where(~held_out(4)))
    return drop_rows(docs, written(language_id.rejected(docs, model, LEAST_SCORE), "gone"), "digest")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, that with the largest doc_id stays.

    Rows that repeat a doc_id with an equal text are the same document and all stay; with different texts each is
    judged by its own.  Null and empty texts are one group; a null doc_id is smaller than any other.
    """
    gone = exact_dedup.exact_groups(docs).where("not kept").select("doc_id", F.substring("text_sha256", 1, 32).alias("digest")).distinct()
    return drop_rows(docs, written(gone, "gone"), "digest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-duplicates, the document with the smallest doc_id stays.

    Documents without words are linked with nothing and stay, as does a null doc_id; rows that repeat a doc_id stay or
    go together.
    """
    found = jaccard_join.near_duplicates(docs)
    return drop_rows(docs, written(found.where("doc_id != component_id").select("doc_id").distinct(), "gone"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the sources to their targets: a document is there as often as the mix takes it.

    Documents without words are never taken; a null source is a source of its own; repeated rows each count.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids, decoded texts and spans of what is left, as digests; one row per row, null text as empty."""
    return sentencepiece_codec.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", identify), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("SentencePiece", encode)]

#: Language identification and SentencePiece cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again, applied to documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
