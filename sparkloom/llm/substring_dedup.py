"""Removal of repeated word windows by recompression.

Recompression names a sequence level by level: in each round, runs of an equal symbol get a name, then symbols are
divided in two halves and every adjacent pair (left half, right half) gets a name.  Names are made by hashing what
they stand for, so all tasks of a round name alike without a dictionary, and equal substrings get equal symbols but
for a few at their ends.  Every symbol remembers the words that decided on it (its own and neighbours looked at).

A window of words is represented by the symbol of the highest level whose deciding words all lie inside it (of
several, the one with the smallest scrambled name).  Equal windows have equal representatives at equal distances, so
a window can only repeat where its representative occurs in two documents.  Only windows of shared representatives
are compared, by 128-bit names of all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import pick, slices, small_batches, written
from sparkloom.llm._words import mix, powers, window_names, words

WINDOW, ROUNDS = 50, 5
#: Every how many rounds runs are named.
RUNS_EVERY = 3
BROADCAST_IDS = 1_000_000


class Level:
    """The symbols of one round over several texts: name, first and end deciding word, text."""

    def __init__(self, name, low, high, text):
        self.name, self.low, self.high, self.text = name, low, high, text

    def __len__(self) -> int:
        return len(self.name)


def _neighbours(x: Level) -> tuple[np.ndarray, np.ndarray]:
    """(low of the symbol before, high of the symbol behind) within the same text; beyond its ends: outside of any window."""
    before = np.concatenate([[-1], x.low[:-1]])
    behind = np.concatenate([x.high[1:], [1 << 60]])
    edge = x.text[1:] != x.text[:-1]
    before[1:][edge] = -1
    behind[:-1][edge] = 1 << 60
    return before, behind


def name_runs(x: Level) -> Level:
    """Maximal runs of a symbol become one; both neighbours of a run decide on it."""
    if not len(x):
        return x
    before, behind = _neighbours(x)
    new = np.concatenate([[True], (x.name[1:] != x.name[:-1]) | (x.text[1:] != x.text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    n = (last - first + 1).astype(np.uint64)
    name = np.where(n > 1, mix(x.name[first] + n * np.uint64(0x8CB92BA72F3D8DD7), 11), x.name[first])
    return Level(name, before[first], behind[last], x.text[first])


def name_pairs(x: Level, salt: int) -> Level:
    """Adjacent (left half, right half) symbols become one; a symbol that stays alone was decided by its neighbour too."""
    if not len(x):
        return x
    before, behind = _neighbours(x)
    right = (mix(x.name, salt) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(x), bool)
    joined[:-1] = ~right[:-1] & right[1:] & (x.text[:-1] == x.text[1:])
    eaten = np.concatenate([[False], joined[:-1]])
    low = np.where(right, before, x.low)
    high = np.where(right, x.high, behind)
    at = np.flatnonzero(joined)
    low[at], high[at] = x.low[at], x.high[at + 1]
    name = x.name.copy()
    name[at] = mix(x.name[at] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(x.name[at + 1], 12), 13)
    keep = ~eaten
    return Level(name[keep], low[keep], high[keep], x.text[keep])


def levels(name: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """The words and the symbols of each round."""
    at = np.arange(len(name))
    out = [Level(name, at, at + 1, text)]
    for r in range(rounds):
        x = out[-1]
        if r % RUNS_EVERY == 0:
            x = name_runs(x)
        out.append(name_pairs(x, 20 + r))
    return out


def representatives(name: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(start of each full window, key of its representative and the words that decided on it)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(name)
    full = np.zeros(n, bool)
    if n >= window:
        full[: n - window + 1] = text[: n - window + 1] == text[window - 1 :]
    start = np.flatnonzero(full)
    key = np.zeros(len(start), np.uint64)
    todo = np.arange(len(start))
    up, down = powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(name * up[:n], out=run[1:])
    for level, x in reversed(list(enumerate(levels(name, text, rounds)))):
        ok = (x.low >= 0) & (x.high < 1 << 60) & (x.high - x.low <= window)
        low, high, rank = x.low[ok], x.high[ok], mix(x.name[ok], 30 + level)
        if not len(low) or not len(todo):
            continue
        # deciding spans are in order: those inside a window are neighbours
        a = np.searchsorted(low, start[todo], side="left")
        b = np.searchsorted(high, start[todo] + window, side="right")
        some = b > a
        hit, a, b = todo[some], a[some], b[some]
        if not len(hit):
            continue
        best = _range_argmin(rank, a, b)
        # the deciding words are the same in equal windows: with them the key tells much more than the symbol alone
        span = (run[high[best]] - run[low[best]]) * down[low[best]]
        key[hit] = mix(rank[best] + mix(span + np.uint64(level), 41), 40)
        todo = todo[~some]
    return start, key


def _range_argmin(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place of the smallest value in each range [a, b)."""
    table = [np.arange(len(value))]
    size = 1
    most = int((b - a).max())
    while 2 * size <= most:
        x = table[-1]
        u, v = x[: len(x) - size], x[size:]
        table.append(np.where(value[v] < value[u], v, u))
        size *= 2
    step = np.frexp((b - a).astype(float))[1] - 1
    out = np.empty(len(a), np.int64)
    for s in np.unique(step).tolist():
        m = step == s
        u, v = table[s][a[m]], table[s][b[m] - (1 << s)]
        out[m] = np.where(value[v] < value[u], v, u)
    return out


def _plain(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _keys(docs: DataFrame, window: int) -> DataFrame:
    """key, doc_id: the distinct representatives of the windows of each document."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids = batch.column(0).to_numpy()
                name, two, first = words([_plain(t) for t in batch.column(1).to_pylist()])
                start, key = representatives(name, first, window)
                doc = np.searchsorted(first, start, side="right") - 1
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[doc[new]])], schema=schema)

    return docs.mapInArrow(run, "key long, doc_id long")


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """h1, h2, doc_id, at: names of the windows (by first word) whose representative is among ``shared`` keys."""

    def run(batches):
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32())])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids = batch.column(0).to_numpy()
                name, two, first = words([_plain(t) for t in batch.column(1).to_pylist()])
                start, key = representatives(name, first, window)
                doc = np.searchsorted(first, start, side="right") - 1
                shared = [np.asarray(x, np.int64) for x in batch.column(2).to_pylist()]
                salt = np.concatenate([mix(x.view(np.uint64) ^ np.uint64(i), 50) if len(x) else x.view(np.uint64) for i, x in enumerate(shared)]) if shared else np.zeros(0, np.uint64)
                hit = np.isin(mix(key ^ doc.astype(np.uint64), 50), salt)
                start, doc = start[hit], doc[hit]
                one, two = window_names(name, window), window_names(two, window)
                yield pa.RecordBatch.from_arrays([pa.array(one[start].view(np.int64)), pa.array(two[start].view(np.int64)), pa.array(ids[doc]), pa.array((start - first[doc]).astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, at int")


def _result(docs: DataFrame, window: int) -> DataFrame:
    """Counts and the digest of the kept words; ``docs`` has doc_id, text, whole (drop all) and starts (of windows to drop)."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        for batch_ in batches:
            for batch in slices(batch_, "text", 2 << 20):
                n, removed, sha = [], [], []
                for text, whole, starts in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                    found = _plain(text).split()
                    kept = found
                    if whole and len(found) >= window:
                        kept = []
                    elif starts:
                        drop = np.zeros(len(found) + 1, np.int64)
                        np.add.at(drop, starts, 1)
                        np.add.at(drop, np.minimum(np.array(starts) + window, len(found)), -1)
                        kept = [found[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                    n.append(len(found)), removed.append(len(found) - len(kept)), sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A word is removed if it is covered by a window of ``window`` consecutive words whose sequence also starts in a
    document with a smaller doc_id; the input alone is judged.  ``kept_sha256`` is that of the kept words joined by
    single spaces.  Null text and texts of fewer words than a window lose nothing.  Rows that repeat a doc_id do not
    count as smaller than each other; rows with a null doc_id neither lose words nor make others lose any.  An empty
    table gives an empty result.

    A document that repeats the word sequence of a smaller one as a whole loses everything if it is long enough,
    and is left out of all further steps, for what it holds starts in the smaller one too.
    """
    small_batches(docs)
    base = pick(docs, "doc_id", "text")

    def sequence(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = [_plain(t).split() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(b" ".join(w)).digest() if len(w) >= window else None for w in found], pa.binary())], schema=schema)

    keyed = written(base.where("doc_id is not null").mapInArrow(sequence, "doc_id long, key binary").where("key is not null"), "sequences")
    copies = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = written(keyed.join(copies, "key").where("doc_id > least").select("doc_id").distinct(), "copies")
    texts = base.where("doc_id is not null and text is not null")
    few = copies.count() <= BROADCAST_IDS
    alone = texts.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")

    keys = written(_keys(alone, window), "keys")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    by_doc = written(keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "shared")
    rows = written(_window_rows(alone.join(by_doc, "doc_id"), window), "windows")
    least = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2", "a")
    drop = rows.join(least, ["h1", "h2"]).where("doc_id > a").groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    marks = copies.select("doc_id", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")).unionByName(drop.select("doc_id", F.lit(False).alias("whole"), "starts"))
    marks = written(marks, "marks")
    return _result(base.join(marks, "doc_id", "left").select("doc_id", "text", "whole", "starts"), window)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the windows of 50 words that start in smaller ones."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS a FROM win GROUP BY h),
hit AS (SELECT win.doc_id, win.i FROM win JOIN first USING (h) WHERE win.doc_id > first.a),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hit),
word AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS p, unnest(ws) AS x FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
