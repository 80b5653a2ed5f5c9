"""Token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer is compiled into two deterministic machines.  The first finds where pre-tokens begin;
it looks at character classes within a fixed window.  The second reads the bytes of a pre-token; each transition
is annotated with the number of tokens that it adds to (or takes from) the count, so that the sum along a path is
the number of tokens.  Its states are determinised lazily: a state is what future merges can see, which is the
longest suffix that some vocabulary entry starts with and the last tokens of the prefixes inside it.

A pre-token boundary resets the second machine, so what a chunk of text does to the state of the text before it
is told by three things: the head before its first sure boundary, the tokens between, and the tail after its last
one.  These chunk maps compose associatively and are combined by a prefix scan; the chunks of a long
text are read by several tasks.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import pick, slices

#: Code points of a chunk; longer texts are scanned chunk by chunk.
CHUNK = 1 << 16
#: States after which a worker compiles anew.
MAX_STATES = 250_000
L, N, SPACE, OTHER_SPACE, O, QUOTE = range(6)
END, UNKNOWN = 255, 254


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What the transducer needs of a tokenizer file: vocabulary, merge ranks, special strings.

    Only byte-level BPE with the usual splitting pattern is understood; anything else is an error.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError("not a byte-level BPE tokenizer with the usual pattern")
    to_byte = byte_alphabet()
    as_bytes = lambda s: bytes(to_byte[c] for c in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
    return {
        "vocab": sorted(as_bytes(s) for s in model["vocab"] if all(c in to_byte for c in s)),
        "ranks": ranks,
        "special": [t["content"] for t in spec["added_tokens"]],
    }


class Classes:
    """The class of each code point as the library's own splitter treats it; asked for when first met."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.table = np.full(0x110001, UNKNOWN, np.uint8)
        self.table[0x110000] = END
        self.table[0xD800:0xE000] = O
        self.table[[ord(" "), ord("'")]] = SPACE, QUOTE

    def of(self, points: np.ndarray) -> np.ndarray:
        """The classes of code points (0x110000: the end of a text)."""
        found = self.table[points]
        if (found == UNKNOWN).any():
            for p in np.unique(points[found == UNKNOWN]).tolist():
                joins = lambda before, c=chr(p): len(self.splitter.pre_tokenize_str(before + c)) == 1
                self.table[p] = L if joins("a") else N if joins("1") else O if joins("!") else OTHER_SPACE
            found = self.table[points]
        return found


class Transducer:
    """The second machine.  ``counts`` runs it over many pre-tokens at once, one byte of each a step."""

    def __init__(self, vocab: list[bytes], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks, self.vocab = ranks, set(vocab)
        self.starts = {t[:i] for t in vocab for i in range(len(t) + 1)}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the first."""
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        # a state: (suffix, per position in it: last token there and tokens up to there less those up to the end);
        # None at a position from which no vocabulary entry can still begin
        start = (b"", ((b"", 0),))
        self.states, self.number = [start], {start: 0}
        self.columns = np.full(256, -1, np.int32)
        self.n_columns = 0
        self.next = np.full((1024, 64), -1, np.int32)
        self.adds = np.zeros((1024, 64), np.int8)

    def pair(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens a and b can follow each other: merging the bytes of both gives just them."""
        known = self.valid.get((a, b))
        if known is None:
            known = self.valid[a, b] = merge(a + b, self.ranks) == [a, b]
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of one state on one byte, made when it is first needed."""
        suffix, history = self.states[state]
        grown, one = suffix + bytes([byte]), bytes([byte])
        for length in range(len(grown), 0, -1):  # the longest token that fits behind the prefix it leaves
            token = grown[-length:]
            if token in self.vocab:
                before, less = history[len(grown) - length]
                if not before or self.pair(before, token):
                    break
        else:
            token, (before, less) = one, history[-1]
        count = less + 1  # of the grown prefix, less that of the old one
        history = [None if h is None or grown[i:] not in self.starts else (h[0], h[1] - count) for i, h in enumerate(history)]
        while grown and history[0] is None:
            grown, history = grown[1:], history[1:]
        history = (*history, (token, 0))
        new = (grown, history)
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
            if to >= len(self.next):
                more = (min(len(self.next), 1 << 15), self.next.shape[1])
                self.next = np.concatenate([self.next, np.full(more, -1, np.int32)])
                self.adds = np.concatenate([self.adds, np.zeros(more, np.int8)])
        return to, count

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[start : start + length]."""
        if len(self.states) > MAX_STATES:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        alive = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), side="right")
        for i, n in enumerate(alive.tolist()):
            byte = data[at[:n] + i]
            column = self.columns[byte]
            if (column < 0).any():
                for b in np.unique(byte[column < 0]).tolist():
                    if self.n_columns == self.next.shape[1]:
                        more = (len(self.next), 32)
                        self.next = np.concatenate([self.next, np.full(more, -1, np.int32)], axis=1)
                        self.adds = np.concatenate([self.adds, np.zeros(more, np.int8)], axis=1)
                    self.columns[b] = self.n_columns
                    self.n_columns += 1
                column = self.columns[byte]
            to = self.next[state[:n], column]
            new = np.flatnonzero(to < 0)
            if len(new):
                for key in np.unique(state[new].astype(np.int64) << 8 | byte[new]).tolist():
                    s, b = key >> 8, key & 255
                    t, c = self.step(s, b)
                    self.next[s, self.columns[b]], self.adds[s, self.columns[b]] = t, c
                to = self.next[state[:n], column]
            total[:n] += self.adds[state[:n], column]
            state[:n] = to
        out = np.empty_like(total)
        out[order] = total
        return out


def merge(data: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Plain BPE of a few bytes: the lowest ranked pair first, from the left."""
    parts = [bytes([b]) for b in data]
    while len(parts) > 1:
        rank, i = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def boundaries(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point of a text; c: their classes.

    Letters, digits, and other signs (with apostrophes) form runs; a run takes one space before it; of white space
    before anything else, the last character stands apart; 's 't 'm 'd 're 've 'll count as pre-tokens where an
    apostrophe begins one.
    """
    n = len(points)
    at = np.full(n + 4, END, np.uint8)
    at[2 : n + 2] = c
    prev, here, after = at[1 : n + 1], c, at[3 : n + 3]
    sign = lambda x: (x == O) | (x == QUOTE)
    blank = lambda x: (x == SPACE) | (x == OTHER_SPACE)
    same = (here == prev) & ((here == L) | (here == N)) | sign(here) & sign(prev)
    begins = ~(same | (prev == SPACE) & ~blank(here))
    # white space: a run starts a pre-token; its last character starts another if something else follows
    begins[blank(here) & blank(prev)] = False
    begins |= blank(here) & blank(prev) & ~blank(after) & (after != END)
    begins[:1] = True
    quote = np.flatnonzero((here == QUOTE) & begins)
    if len(quote):
        text = np.zeros(n + 3, np.int64)
        text[:n] = points
        a, b = text[quote + 1], text[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begins[quote[one | two] + 1] = False
        for found, size in ((quote[one], 2), (quote[two], 3)):
            end = found + size
            # what follows a contraction begins a pre-token; it isn't joined to the letters of the contraction
            begins[end[end < n]] = True
            inside = found + 1
            begins[inside] = False
    return begins


class Counter:
    """Counts the tokens of texts, special strings counting as one each."""

    def __init__(self, spec: dict):
        self.machine = Transducer(spec["vocab"], spec["ranks"])
        self.classes = Classes()
        self.special = spec["special"]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = [t or ""]
            for s in self.special:  # the library cuts these out before anything else
                if any(s in p for p in parts):
                    split = [p.split(s) for p in parts]
                    extra[i] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            pieces += [p for p in parts if p]
            owner += [i] * sum(1 for p in parts if p)
        out = extra
        if pieces:
            np.add.at(out, owner, self._joined(pieces))
        return out.tolist()

    def _joined(self, pieces: list[str]) -> np.ndarray:
        """Counts of several pieces, found in one run of the machines."""
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(sizes) - sizes
        # a mark behind each piece stands for its end
        spaced = np.full(len(points) + len(pieces) * 4, 0x110000, np.int64)
        to = np.arange(len(points)) + np.repeat(np.arange(len(pieces)) * 4, sizes)
        spaced[to] = points
        begins = boundaries(spaced, self.classes.of(spaced))[to]
        begins[first] = True
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer("".join(pieces).encode("utf-8", "surrogatepass"), np.uint8)
        where = np.flatnonzero(begins)
        edge = offset[np.append(where, len(points))]
        per = self.machine.counts(data, edge[:-1], np.diff(edge))
        total = np.concatenate([[0], np.cumsum(per)])
        k = np.searchsorted(where, np.append(first, len(points)))
        return total[k[1:]] - total[k[:-1]]

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens, tail) of a chunk: what a scan that enters it in any state has to know of it.

        Between the first and the last place where the automaton is in its starting state whatever came before (white
        space behind anything else), the tokens are counted; head and tail stay text.  Tail None: there is no such
        place and the chunk is all head.  Special strings have no white space, so none reaches over such a place.
        """
        points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.classes.of(points)
        blank = (c == SPACE) | (c == OTHER_SPACE)
        sure = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        if not len(sure):
            return chunk, 0, None
        a, b = int(sure[0]), int(sure[-1])
        return chunk[:a], self._tokens(chunk[a:b]), chunk[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The map of two chunks that follow each other; associative."""
        if x[2] is None and y[2] is None:
            glued = x[0] + y[0]
            return self.chunk_map(glued)
        if x[2] is None:
            a, n, t = self.chunk_map(x[0] + y[0])
            if t is None:
                return a, y[1], y[2]
            return a, n + self._tokens(t) + y[1], y[2]
        if y[2] is None:
            a, n, t = self.chunk_map(x[2] + y[0])
            if t is None:
                return x[0], x[1], a
            return x[0], x[1] + self._tokens(a) + n, t
        return x[0], x[1] + self._tokens(x[2] + y[0]) + y[1], y[2]

    def _tokens(self, text: str) -> int:
        return self.count([text])[0] if text else 0

    def total(self, maps: list[tuple]) -> int:
        """Tokens of a text from the maps of its chunks, combined pair by pair in log2 rounds."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self._tokens(head) + n + self._tokens(tail or "")


def _scan(long: DataFrame, spec, chunk: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of long texts: chunks go to all tasks, each gives its map, and the maps of a text, which
    are as small as the distance between white space, are composed in one place."""

    def cut(batches):
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("chunk", pa.string())])
        for batch in batches:
            for row, doc, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                for i in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([i]), pa.array([text[i : i + chunk]])], schema=schema)

    def maps(batches):
        counter = Counter(spec.value)
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64()), ("head", pa.string()), ("n", pa.int64()), ("tail", pa.string())])
        for whole in batches:
            for batch in slices(whole, "chunk", 4 << 20):
                texts = batch.column(3).to_pylist()
                head, n, tail = zip(*[counter.chunk_map(t) for t in texts], strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())], schema=schema)

    def join(pdf):
        pdf = pdf.sort_values("at")
        parts = [(h, int(n), t) for h, n, t in zip(pdf["head"], pdf["n"], pdf["tail"], strict=True)]
        doc = pdf["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(doc) else int(doc)], "Int64"), "n_bytes": [int(pdf["bytes"].sum())], "n_tokens": [Counter(spec.value).total(parts)]})

    rows = long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, "row long, doc_id long, at long, chunk string")
    found = rows.repartition("row", "at").mapInArrow(maps, "row long, doc_id long, at long, bytes long, head string, n long, tail string")
    return found.groupBy("row").applyInPandas(join, "doc_id long, n_bytes long, n_tokens long")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    The counts are those of the library for the tokenizer file at ``path`` without added special tokens; special
    strings inside a text count as one token.  Null text counts as empty: no bytes, no tokens.  Texts of more than
    ``chunk`` characters are scanned in chunks by several tasks; every row gives one row, repeated or not.
    """
    loaded = load(path)
    spec = docs.sparkSession.sparkContext.broadcast(loaded)  # as large as the vocabulary

    def run(batches):
        counter = Counter(spec.value)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                texts = batch.column(1).to_pylist()
                size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(counter.count(texts), pa.int64())], schema=schema)

    base = pick(docs, "doc_id", "text")
    if any(any(x.isspace() for x in s) for s in loaded["special"]):  # white space is no sure place then
        out = base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    else:
        is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
        out = base.where(~is_long).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").unionByName(_scan(base.where(is_long), spec, chunk))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
