"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
#: One word: a run of anything but the six ASCII space characters.  ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others.

    Names are matched exactly and by position, so further columns whose names differ only in case do no harm.
    A name that is missing is an error.
    """
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


#: Up to so many ids, a filter by ids is broadcast; beyond it, it is a shuffle join.
BROADCAST_IDS = 1_000_000


def drop_rows(docs: DataFrame, dropped: DataFrame, same: str | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, but those whose doc_id is among ``dropped``'s (nulls match nulls).

    ``dropped`` is a written table with doc_id and maybe a column named ``same``: then a row goes only if the digest of
    its text, with A-Z in lower case, begins with it, so that rows that repeat a doc_id are told apart.  The ids are
    broadcast if they are few, so the texts need not move.
    """
    names = docs.columns
    id_, text = [F.col(f"_c{names.index(n)}") for n in ("doc_id", "text")]
    left = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    right = dropped.select(F.col("doc_id").alias("_key"), *([F.col(same).alias("_same")] if same else []))
    right = F.broadcast(right) if dropped.count() <= BROADCAST_IDS else right
    on = id_.eqNullSafe(F.col("_key"))
    if same:
        low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
        on = on & F.startswith(F.sha2(low.cast("binary"), 256), F.col("_same"))
    return left.join(right, on, "left_anti").toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing (tests, a laptop) a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-shared")
    return f"{base.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path.rsplit("/", 1)[0]
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once all that reads them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: workers are kept between stages, and theirs would add up."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: Bytes of rows that Spark hands to a Python worker at once; its own bound is 64 MB, held by both sides of each task.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """From now on the session of ``df`` hands rows to Python workers by ``BATCH_BYTES``, if it has no bound of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    conf.set(key, conf.get(key, str(BATCH_BYTES)))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values of a string column have about ``most`` bytes together (one row at least)."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.nan_to_num(np.asarray(pc.binary_length(values).to_numpy(zero_copy_only=False), dtype=float))
    begin, total = 0, 0.0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0.0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)
    release()


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case, and no other change; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def held_out(modulus: int, left: int = 2) -> F.Column:
    """Whether crc32 of the id as text leaves ``left``; a null id never does."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == left, F.lit(False))
