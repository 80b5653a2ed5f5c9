"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts.  A text is coded byte by byte as its lower-cased tokens, each closed by a space,
and the end; the contexts are the bytes before, over the bounds of words (``across``), of which the space in front of the
text is the first.  Without ``across`` every token has its own context, which begins with the space in front.  A byte that a context has not seen costs an escape (method C: as many escapes
as distinct symbols) and is looked for in the next shorter context without the symbols that the longer one excludes;
below the empty context all remaining bytes are equally likely.

A symbol with the bytes of context before it is a gram.  The grams of all texts are counted in the tasks and gathered by
a shuffle, and no counted gram is dropped.  The trie is partitioned by the last two bytes of context: a part with the
edges of the two lowest orders (65,792 at most) can score its grams by itself.  The scores of the most frequent grams go
to every worker, the others are joined by a shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import ascii_lower, held_out, pick, slices, written

#: Longest context in bytes (at most 5), words and grams whose scores every worker holds.
ORDER, FREQUENT, FREQUENT_GRAMS = 5, 200_000, 1 << 20
#: Entries of a count table in a worker before it is handed on; grams after which a part of the trie is scored.
FLUSH, PART = 400_000, 250_000
#: The token that ends a text; no word holds a line feed.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case, and the end."""
    return [*ascii_lower(text).split(), END]


# training --------------------------------------------------------------------------------------------------------


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, positions of the symbols to code, word of each, how many bytes of context each has).

    Every word stands between two spaces; the end token has one space before it and codes itself alone.
    """
    data = b"".join([b" \n" if w == END else b" " + w + b" " for w in words])
    sizes = np.fromiter((2 if w == END else len(w) + 2 for w in words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(data)) - first[word]
    at = np.flatnonzero(depth > 0)
    return np.frombuffer(data, np.uint8).astype(np.int64), at, word[at], depth[at]


def context_keys(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """order << 48 | the ``order`` bytes before each position."""
    key = np.zeros(len(at), np.int64)
    for back in range(order, 0, -1):
        key = key << 8 | data[at - back]
    return key | order << 48


def gram_keys(data: np.ndarray, at: np.ndarray, depth: np.ndarray, order: int) -> np.ndarray:
    """bytes of context << 56 | the context << 8 | symbol at each position, whose context has ``order`` bytes at most."""
    used = np.minimum(depth, order)
    context = context_keys(data, at, order) & ((1 << 8 * used) - 1)
    return (used << 48 | context) << 8 | data[at]


def text_grams(found: list[list[bytes]], order: int = ORDER, across: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) of every symbol of texts that are given as tokens."""
    streams = [b" " + b" ".join(w) for w in found]
    data = np.frombuffer(bytes(order) + b"".join(streams), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    place = np.arange(len(data))
    text = np.repeat(np.arange(len(streams)), sizes)
    first = np.zeros(len(data), bool)
    first[order + np.cumsum(sizes) - sizes] = True
    at = np.flatnonzero(~first[order:]) + order
    begin = np.maximum.accumulate(np.where(first if across else data == 32, place, 0))
    return gram_keys(data, at, at - begin[at - 1], order), text[at - order]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, with the sums of their counts."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[start], np.add.reduceat(counts[by], start) if len(keys) else counts


def edges_of(grams: np.ndarray, n: np.ndarray, orders: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | symbol, count) of the contexts of some lengths, from grams that were seen n times."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in orders:
        p = grams >> 56 >= k
        u, c = summed(grams[p] & ((1 << 8 * (k + 1)) - 1) | k << 56, n[p])
        keys.append(u), counts.append(c)
    return np.concatenate(keys), np.concatenate(counts)


def edge_counts(words: list[bytes], n: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | symbol, count) over words that occur n times each, for the contexts of all lengths."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, at, word, depth = laid_out(words)
    return edges_of(gram_keys(data, at, depth, order), np.asarray(n, np.int64)[word], range(order + 1))


class Model:
    """Log10 probabilities of a trie, from its edges' keys and counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        by = np.argsort(keys)
        self.order, self.keys, n = order, keys[by], counts[by].astype(float)
        self.nodes, start, which = np.unique(self.keys >> 8, return_index=True, return_inverse=True) if len(keys) else (np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, int))
        total = np.add.reduceat(n, start) if len(keys) else np.zeros(0)
        distinct = np.diff(np.append(start, len(keys))).astype(float)
        depth = self.nodes >> 48
        with np.errstate(divide="ignore", invalid="ignore"):
            self.hit = np.log10(n / (total + distinct)[which]) if len(keys) else n
            self.escape = np.log10(distinct / (total + distinct))
            # what remains of the suffix context once the symbols of the context are excluded
            suffix = np.where(depth > 0, (depth - 1) << 48 | self.nodes & ((1 << 8 * np.maximum(depth - 1, 0)) - 1), -1)
            link = np.searchsorted(self.nodes, suffix)
            inner = depth > 0
            e = inner[which] if len(keys) else np.zeros(0, bool)
            below = np.searchsorted(self.keys, suffix[which[e]] << 8 | self.keys[e] & 255)
            excluded = np.bincount(which[e], n[below], len(self.nodes))
            link[~inner] = 0
            left = (distinct[link] if len(link) else distinct) - distinct
            self.space = np.log10(total[link] - excluded + left) if len(link) else total
            self.escape_left = np.where(left > 0, np.log10(left) - self.space, 0.0) if len(link) else total
        self.count = np.log10(n)
        root = int(distinct[0]) if len(self.nodes) and self.nodes[0] == 0 else 0
        self.floor = float(-np.log10(256 - root)) if root < 256 else 0.0

    def _find(self, table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(key), int), np.zeros(len(key), bool)
        i = np.searchsorted(table, key)
        i[i == len(table)] = 0
        return i, table[i] == key

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each word, its closing space included."""
        if not words:
            return np.zeros(0)
        data, at, word, depth = laid_out(words)
        return np.bincount(word, self.score_grams(gram_keys(data, at, depth, self.order)), len(words))

    def score_grams(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of the symbol of each gram."""
        depth, low = grams >> 56, grams & ((1 << 48) - 1)
        out = np.zeros(len(grams))
        came = np.full(len(grams), -1)  # the longer context that we escaped from
        open_ = np.arange(len(grams))
        for k in range(self.order, -1, -1):
            p = open_[depth[open_] >= k]
            want = low[p] & ((1 << 8 * (k + 1)) - 1) | k << 56
            node, known = self._find(self.nodes, want >> 8)
            p, node, want = p[known], node[known], want[known]
            edge, seen = self._find(self.keys, want)
            fresh = came[p] < 0
            m = came[p]
            out[p] += np.where(fresh, np.where(seen, self.hit[edge], self.escape[node]), np.where(seen, self.count[edge] - self.space[m], self.escape_left[m]))
            came[p] = node
            done = np.zeros(len(grams), bool)
            done[p[seen]] = True
            open_ = open_[~done[open_]]
        out[open_] += self.floor
        return out


class Scores:
    """A table of grams' scores, the most frequent first: a slot for most, a sorted rest for those whose slot is taken."""

    def __init__(self, grams: np.ndarray, scores: np.ndarray, bits: int = 21):
        self.bits = bits
        self.grams, self.scores = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot = self._slot(grams)
        _, first = np.unique(slot, return_index=True)
        self.grams[slot[first]], self.scores[slot[first]] = grams[first], scores[first]
        late = np.ones(len(grams), bool)
        late[first] = False
        by = np.argsort(grams[late])
        self.rest, self.rest_scores = grams[late][by], scores[late][by]

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, whether each gram is in the table)."""
        slot = self._slot(grams)
        known = self.grams[slot] == grams
        out = np.where(known, self.scores[slot], 0.0)
        if len(self.rest):
            p = np.flatnonzero(~known)
            i = np.searchsorted(self.rest, grams[p])
            i[i == len(self.rest)] = 0
            hit = self.rest[i] == grams[p]
            out[p[hit]], known[p[hit]] = self.rest_scores[i[hit]], True
        return out, known


class Adaptive:
    """PPM that learns as it codes; also the plain form of the trained model, for tests."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(Counter)

    def learn(self, context: bytes, symbol: int, n: int = 1) -> None:
        for k in range(min(self.order, len(context)) + 1):
            self.counts[context[len(context) - k :]][symbol] += n

    def log10(self, context: bytes, symbol: int) -> float:
        """Log10 probability of a symbol behind a context."""
        total, excluded = 0.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            size = sum(left.values()) + len(left)
            if symbol in left:
                return total + np.log10(left[symbol] / size)
            if left:
                total += np.log10(len(left) / size)
            excluded |= seen.keys()
        return total - np.log10(256 - len(excluded)) if len(excluded) < 256 else total

    def code(self, words: list[bytes], learn: bool = True, across: bool = False) -> float:
        """Log10 probability of tokens in order; with ``learn``, each symbol is learnt after it is coded."""
        total, context = 0.0, b" "
        for w in words:
            spelt = [END[0]] if w == END else [*w, 32]
            if not across:
                context = b" "
            for s in spelt:
                total += self.log10(context, s)
                if learn:
                    self.learn(context, s)
                context = (context + bytes([s]))[-max(self.order, 1) :]
        return float(total)


# Spark -----------------------------------------------------------------------------------------------------------


def token_table(docs: DataFrame) -> DataFrame:
    """word binary, n: tokens of ``docs`` (doc_id, text, train boolean) with their counts in training documents.

    Tokens of other documents alone are there too, with 0.  Counted in each task before the shuffle.
    """

    def count(batches):
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        train, other = Counter(), set()

        def flush():
            new = [w for w in other if w not in train]
            out = pa.RecordBatch.from_arrays([pa.array([*train, *new], pa.binary()), pa.array([*train.values(), *[0] * len(new)], pa.int64())], schema=schema)
            train.clear(), other.clear()
            return out

        for whole in batches:
            for batch in slices(whole, "text"):
                for text, use in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    train.update(tokens(text)) if use else other.update(tokens(text))
                if len(train) + len(other) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text", "train").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_table(docs: DataFrame, order: int = ORDER, across: bool = True) -> DataFrame:
    """gram, n: all grams of ``docs`` (doc_id, text, train boolean) with their counts in training documents (0 if none)."""

    def count(batches):
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def batch_of(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], schema=schema)

        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                grams, text = text_grams([tokens(t) for t in batch.column(0).to_pylist()], order, across)
                use = batch.column(1).to_numpy(zero_copy_only=False)[text]
                for part, seen in ((grams[use], True), (grams[~use], False)):
                    k, c = np.unique(part, return_counts=True)
                    keys.append(k), counts.append(c if seen else np.zeros(len(k), np.int64))
                if sum(map(len, keys)) > 4 * FLUSH:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    if len(k) > 2 * FLUSH:
                        yield batch_of(k, c)
                        k, c = k[:0], c[:0]
                    keys, counts = [k], [c]
        yield batch_of(*summed(np.concatenate(keys), np.concatenate(counts)))

    return docs.select("text", "train").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def scored_grams(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n, lp: log10 probabilities by the model of all grams with n > 0.

    Contexts of two bytes and more lie in the part of their last two bytes, with all grams that reach them; shorter
    ones go to every worker.
    """
    short = F.expr("if(gram >= 1L << 56, 1L << 56, 0L) | (gram & 65535L)")
    got = grams.where("n > 0").groupBy(short.alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # 65,792 rows at most
    low = grams.sparkSession.sparkContext.broadcast(edges_of(got.column(0).to_numpy(), got.column(1).to_numpy(), range(min(order, 1) + 1)))

    def run(batches):
        schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("lp", pa.float64())])

        def score(g, n):
            k, c = edges_of(g[n > 0], n[n > 0], range(2, order + 1))
            model = Model(np.concatenate([low.value[0], k]), np.concatenate([low.value[1], c]), order)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(model.score_grams(g))], schema=schema)

        g, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            g, n = np.concatenate([g, batch.column(0).to_numpy()]), np.concatenate([n, batch.column(1).to_numpy()])
            if len(g) > PART:
                part = g >> 8 & 65535
                whole = int(np.searchsorted(part, part[-1]))  # the last part may go on
                if whole:
                    yield score(g[:whole], n[:whole])
                    g, n = g[whole:], n[whole:]
        if len(g):
            yield score(g, n)

    part = F.shiftright("gram", 8).bitwiseAND(65535)
    return grams.repartition(part).sortWithinPartitions(part).mapInArrow(run, "gram long, n long, lp double")


def score_texts(docs: DataFrame, modulus: int = 7, left: int = 2, order: int = ORDER, frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS, across: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document is held out, and nothing learnt from it, if crc32 of its id as text leaves ``left`` modulo
    ``modulus`` (a null id never does).  ``score`` is the log10 probability that the PPM model gives the tokens of
    the text and its end, with contexts that reach over words if ``across``; ``base_score`` that of an add-one unigram model of whole tokens.  Null text counts as
    empty: one token, the end.  Without any training document the trie is empty and every byte costs log10(256).
    An empty table gives an empty result; repeated rows are scored, and counted, each.

    The scores of the ``frequent`` most frequent tokens and of the ``frequent_grams`` most frequent grams go to every
    worker; all other tokens and grams of a document are joined with their tables by a shuffle, whatever their size.
    """
    base = pick(docs, "doc_id", "text").withColumn("held_out", held_out(modulus, left))
    marked = base.withColumn("train", ~F.col("held_out"))
    words = written(token_table(marked), "words")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    n_train, size = int(totals[0]), int(totals[1])
    spark = docs.sparkSession
    log_space = float(np.log10(n_train + size + 1))
    grams = written(scored_grams(written(gram_table(marked, order, across), "grams"), order), "scored")

    def scores(batches):
        schema = pa.schema([("word", pa.binary()), ("known", pa.int64()), ("base", pa.float64())])
        for batch in batches:
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((n > 0).astype(np.int64)), pa.array(np.log10(n + 1) - log_space)], schema=schema)

    ranked = words.orderBy(F.desc("n"), "word").limit(frequent).mapInArrow(scores, "word binary, known long, base double").toArrow()  # at most ``frequent`` rows
    top = spark.sparkContext.broadcast({w: (k, b) for w, k, b in zip(*[c.to_pylist() for c in ranked.columns], strict=True)})
    ranked = grams.orderBy(F.desc("n"), "gram").limit(frequent_grams).select("gram", "lp").toArrow()  # at most ``frequent_grams`` rows
    top_grams = spark.sparkContext.broadcast((ranked.column(0).to_numpy(), ranked.column(1).to_numpy()))

    def partial(batches):
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        rare_grams_type = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int32())]))
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64()), ("rare", rare_type), ("rare_grams", rare_grams_type)])
        table, table_grams, rid = top.value, Scores(*top_grams.value), TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                every = [tokens(text) for text in batch.column(1).to_pylist()]
                keys, where = text_grams(every, order, across)
                got, hit = table_grams.get(keys)
                lps = np.bincount(where, got, len(every)).tolist()
                rare_grams = [[] for _ in every]
                for i, g in zip(where[~hit].tolist(), keys[~hit].tolist(), strict=True):
                    rare_grams[i].append(g)
                rows = []
                for found, lp, odd in zip(every, lps, rare_grams, strict=True):
                    known, base, rare = 0, 0.0, []
                    for w, n in Counter(found).items():
                        hit = table.get(w)
                        if hit is None:
                            rare.append({"word": w, "n": n})
                        else:
                            known += n * hit[0]
                            base += n * hit[1]
                    rows.append((len(found), known, base, lp, rare, [{"gram": g, "n": n} for g, n in Counter(odd).items()]))
                ids = pa.array(np.arange(rid, rid + len(rows)))
                rid += len(rows)
                cols = [pa.array([r[i] for r in rows], schema.types[3 + i]) for i in range(6)]
                yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(2), *cols], schema=schema)

    part = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, lp double, rare array<struct<word binary, n int>>, rare_grams array<struct<gram bigint, n int>>"
    sums = written(base.mapInArrow(partial, part), "partial")
    rare = sums.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
    rare_grams = sums.select("rid", F.explode("rare_grams").alias("r")).select("rid", F.col("r.gram").alias("gram"), F.col("r.n").alias("k"))
    table = words.mapInArrow(scores, "word binary, known long, base double")
    nothing = {"doc_id": F.lit(None).cast("long"), "held_out": F.lit(None).cast("boolean"), "n_tokens": F.lit(None).cast("long")}
    joined = rare.join(table, "word").select("rid", (F.col("known") * F.col("k")).alias("known"), (F.col("base") * F.col("k")).alias("base"), F.lit(0.0).alias("lp"))
    joined_grams = rare_grams.join(grams, "gram").select("rid", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("lp") * F.col("k")).alias("lp"))
    both = sums.drop("rare", "rare_grams").unionByName(joined.unionByName(joined_grams).withColumns(nothing))
    out = both.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, score: log10 probability of each text by a model that starts empty and learns from that text alone."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Adaptive(order).code(tokens(t), across=True) for t in batch.column(1).to_pylist()], pa.float64())], schema=schema)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_ppm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, with contexts that reach over words."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), across=True)
