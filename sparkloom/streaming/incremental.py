"""Incremental vectors from a stream of files: each batch encodes only texts that the cache lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.dense import encode
from sparkloom.sources.store import missing_vectors, put_vectors


def index_stream(spark: SparkSession, source: str, cache: str, checkpoint: str, encoder: Callable, model: str, max_files: int = 64):
    """Reads new Parquet files (doc_id, text) below ``source`` once and appends their new vectors to ``cache``.

    The query ends when nothing is new.  A batch that runs again appends what it had appended; readers take the
    latest row of a text, so that changes nothing.
    """
    schema = "doc_id long, text string"

    def batch(df: DataFrame, _: int) -> None:
        texts = df.where("text is not null").select(F.sha2("text", 256).alias("text_hash"), "text")
        try:
            known = df.sparkSession.read.parquet(cache)
        except Exception as e:  # the cache is made by the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = df.sparkSession.createDataFrame([], "model string, text_hash string, vector array<float>")
        new = encode(missing_vectors(texts, known, model), encoder)
        put_vectors(new.select(F.lit(model).alias("model"), "text_hash", "vector"), cache)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
