"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash over its bytes says so, each chunk gets a short identifier that is verified to
stand for one content only, and a document becomes its ordered list of identifiers.  Documents are compared by
these lists; no text moves between executors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import ascii_lower, pick, slices, small_batches, written

#: A cut falls where the rolling hash's low bits are zero: every 2 ** BITS bytes on average.
BITS, LEAST, MOST, REACH = 11, 1024, 65536, 16
#: A recipe that more rows share, and more than a HOT_GROUPS-th of all, is met by a broadcast and never in one task.
HOT, HOT_GROUPS = 1000, 10_000
#: Bytes of the short identifier of a chunk.
SHORT = 8


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: content-defined, LEAST to MOST bytes long (the last may be shorter)."""
    n = len(data)
    if n <= 2 * LEAST:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = np.zeros(n, np.uint32)
    mult = 1
    for back in range(REACH):  # a hash of the last REACH bytes at every position
        h[back:] += b[: n - back] * np.uint32(mult)
        mult = mult * 0x9E3779B1 + 2 & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    marks = np.flatnonzero((h >> np.uint32(16)) & np.uint32((1 << BITS) - 1) == 0) + 1
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST and n - m >= 1:
            ends.append(m)
            at = m
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, n]


def recipe_of(data: bytes) -> list[bytes]:
    """SHA-256 of each chunk, in order."""
    out, at = [], 0
    for end in cut_points(data):
        out.append(hashlib.sha256(data[at:end]).digest())
        at = end
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("chunks", pa.list_(pa.binary()))])


def _digests(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            low = [ascii_lower(t) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array([hashlib.sha256(x).hexdigest() for x in low]), pa.array([recipe_of(x) for x in low], pa.list_(pa.binary()))], schema=_SCHEMA)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    ``docs`` needs doc_id (long) and text.  Texts are equal when identical after lower-casing A-Z only; of equal
    texts the largest doc_id stays.  Null text counts as empty, and all empty texts are one group.  A null doc_id
    is smaller than any other.  Rows that repeat a doc_id with an equal text are all kept, being the same document.
    An empty table gives an empty result.

    Chunk identifiers are the first bytes of SHA-256.  One pass over the chunk table verifies that no identifier
    stands for two digests; should that happen, recipes are compared by the full digests instead.
    """
    small_batches(docs)
    digests = written(pick(docs, "doc_id", "text").mapInArrow(_digests, "doc_id long, text_sha256 string, chunks array<binary>"), "recipes")
    chunk = digests.select(F.explode("chunks").alias("c")).select(F.substring("c", 1, SHORT).alias("short"), "c")
    clash = chunk.groupBy("short").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a != b").limit(1).count()
    width = 32 if clash else SHORT
    recipe = F.array_join(F.transform("chunks", lambda c: F.hex(F.substring(c, 1, width))), "")
    rows = digests.select("doc_id", "text_sha256", F.size("chunks").alias("n_chunks"), F.unhex(recipe).alias("recipe"))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups, "groups")
    hot = F.col("group_size") > max(HOT, digests.count() // HOT_GROUPS)  # HOT_GROUPS groups at most, which are broadcast
    crowded = F.broadcast(groups.where(hot))
    joined = rows.join(crowded, "recipe").unionByName(rows.join(crowded, "recipe", "left_anti").join(groups.where(~hot), "recipe", "left"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_chunks")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chunks")


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
