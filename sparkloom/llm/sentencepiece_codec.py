"""SentencePiece BPE encoding and decoding that keeps source offsets.

The text is normalised by the longest prefixes that the model's compiled character map knows (a double-array trie),
with white space handled as the model says; every normalised byte remembers the source bytes it came from.  Pieces
are then merged by score, and every piece is projected to the span of original bytes that it covers.

No piece holds the space mark behind another character, so a text is encoded in segments that begin at space marks
(and at characters that occur in no piece), each of which is looked up or merged once a batch.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm._common import pick, slices, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker remembers, in each of two generations.
MEMO = 150_000


class CharacterMap:
    """The compiled character map: a double-array trie over source bytes and the replacements that it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size]) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, source length) of the longest known prefix at a position."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = offset(self.units[0])
        found = None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if (unit & ((1 << 31) | 0xFF)) != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:  # a leaf below holds the place of the replacement
                start = self.units[node] & 0x7FFFFFFF
                found = self.texts[start : self.texts.index(b"\0", start)], i + 1 - at
        return found


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the space mark in front are understood")
        norm = proto.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.fallback = proto.trainer_spec.byte_fallback and len(self.byte_ids) == 256
        self.user = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER), key=lambda p: (-len(p), p))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER, UNUSED)}
        if any(k == UNUSED for k in self.kinds):
            raise ValueError("unused pieces are not understood")
        alone = {c for c in "\n\t\r" if not any(c in p for p in self.ids)}
        #: pieces begin with the mark or do not hold it at all, so that segments are independent
        self.cuts = not any(b == MARK and a != MARK for p in self.ids for a, b in zip(p, p[1:], strict=False))
        inner = "".join(re.escape(c) for c in sorted(alone))
        self.segment = re.compile(f"[{inner}]|{MARK}*[^{MARK}{inner}]+|{MARK}+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many segments at once: symbol pairs -> (rank of the merged piece, its symbol)."""
        chars = sorted({c for p in self.ids for c in p})
        self.symbol = {p: i for i, p in enumerate(sorted(self.ids.keys() | set(chars)))}
        order = sorted(self.ids, key=lambda p: -self.scores[self.ids[p]])
        rank, last = {}, None
        for i, p in enumerate(order):  # equal scores share a rank: then the leftmost pair goes first
            rank[p] = rank[last] if last is not None and self.scores[self.ids[last]] == self.scores[self.ids[p]] else i
            last = p
        rows = []
        for p in self.ids:
            if len(p) > 1 and self.kinds[self.ids[p]] == NORMAL:
                rows += [(self.symbol[p[:k]] << 32 | self.symbol[p[k:]], rank[p], self.symbol[p]) for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        rows.sort()
        self.keys = np.array([r[0] for r in rows] or [-1], np.int64)
        self.ranks = np.array([r[1] for r in rows] or [0], np.int64)
        self.merged = np.array([r[2] for r in rows] or [0], np.int64)
        #: a perfect-enough hash: the place of each key's bucket
        self.piece_of_symbol = sorted(self.symbol)

    # normalisation -------------------------------------------------------------------------------------------

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its characters and its end, the source byte offset it starts at."""
        if not text:
            return "", [0]
        data = text.encode("utf-8", "surrogatepass")
        out: list[tuple[str, int]] = []
        at = 0
        while at < len(data):
            user = next((u for u in self.user if data.startswith(u.encode(), at)), None)
            if user is not None:
                piece, size = user, len(user.encode())
            elif (found := self.map.longest(data, at)) is not None:
                piece, size = found[0].decode("utf-8", "replace"), found[1]
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                piece = data[at : at + size].decode("utf-8", "replace")
                if len(piece) > 1:
                    piece = "�"
            out += [(c, at) for c in piece]
            at += size
        end = len(data)
        if self.squeeze:
            while out and out[0][0] == " ":
                out.pop(0)
            while out and out[-1][0] == " ":
                end = out.pop()[1]
            out = [x for i, x in enumerate(out) if not (x[0] == " " and i and out[i - 1][0] == " ")]
        if self.dummy and out:
            out.insert(0, (" ", out[0][1]))
        mark = MARK if self.escape else " "
        return "".join(mark if c == " " else c for c, _ in out), [*(o for _, o in out), end]

    def plain(self, text: str) -> str:
        """The normalised text alone; fast where the character map is empty and no white space is removed."""
        if self.map.units or self.squeeze or self.user or not self.escape:
            return self.normalize(text)[0]
        return ((MARK if self.dummy else "") + text.replace(" ", MARK)) if text else ""

    # encoding ------------------------------------------------------------------------------------------------

    def segments(self, normal: str) -> list[str]:
        """Parts of a normalised text that are encoded independently."""
        return self.segment.findall(normal) if self.cuts and not self.user else [normal] if normal else []

    def encode_segments(self, parts: list[str]) -> list[list[str]]:
        """The pieces of each segment: pairs are merged by score, all segments at once, one merge each a round."""
        if not parts:
            return []
        chars = "".join(parts)
        if self.user:
            return [self._with_user(p) for p in parts]
        table = {c: self.symbol.get(c, -1) for c in set(chars)}
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        sym = np.fromiter(map(table.__getitem__, chars), np.int64, len(chars))
        begin = np.arange(len(chars) + 1)  # where each symbol starts
        begin = begin[:-1]
        seg = np.repeat(np.arange(len(parts)), sizes)
        done_begin = []
        rank, merged = self._pairs(sym, seg, np.arange(len(sym)))
        while len(i := np.flatnonzero(rank >= 0)):
            owner = seg[i]
            group = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # one merge in each segment: the best score, then the leftmost
            at = np.minimum.reduceat(rank[i] << 32 | i, group) & 0xFFFFFFFF
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            # segments without a merge are finished
            open_ = np.zeros(len(parts), bool)
            open_[owner[group]] = True
            stays = open_[seg]
            done_begin.append(begin[keep & ~stays])
            keep &= stays
            sym, begin, seg, rank, merged = sym[keep], begin[keep], seg[keep], rank[keep], merged[keep]
            new = (np.cumsum(keep) - 1)[at]  # only pairs with a merged symbol have changed
            new = np.concatenate([new, new[new > 0] - 1])
            rank[new], merged[new] = self._pairs(sym, seg, new)
        done_begin.append(begin)
        cut = np.sort(np.concatenate(done_begin))
        edge = np.append(cut, len(chars)).tolist()
        pieces = [chars[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        split = np.searchsorted(cut, np.concatenate([[0], np.cumsum(sizes)])).tolist()
        return [pieces[a:b] for a, b in zip(split, split[1:], strict=False)]

    def _pairs(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of the piece that each symbol at ``at`` makes with the next one of its segment; rank -1: none."""
        behind = np.minimum(at + 1, len(sym) - 1)
        left, right = sym[at], sym[behind]
        same = (behind > at) & (seg[at] == seg[behind]) & (left >= 0) & (right >= 0)
        key = np.where(same, left << 32 | right, -1)
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        return np.where(same & (self.keys[place] == key), self.ranks[place], -1), self.merged[place]

    def _with_user(self, part: str) -> list[str]:
        """Merging around user-defined pieces, which stay whole."""
        pattern = re.compile("(" + "|".join(re.escape(u.replace(" ", MARK)) for u in self.user) + ")")
        kept, self.user = self.user, []
        try:
            return [x for p in pattern.split(part) if p for x in ([p] if p in self.ids and self.kinds[self.ids[p]] == USER else self.encode_segments([p])[0])]
        finally:
            self.user = kept

    def piece_ids(self, piece: str) -> list[int]:
        """The ids of one piece; a character without a piece gives its bytes, or the unknown id."""
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return [i for pieces in self.encode_segments(self.segments(self.plain(text))) for p in pieces for i in self.piece_ids(p)]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of every id in order; the bytes are those of the original text.

        The ids of a character that falls back to bytes all carry the span of that character.
        """
        normal, offsets = self.normalize(text)
        out, at = [], 0
        for pieces in self.encode_segments(self.segments(normal)):
            for p in pieces:
                a, b = offsets[at], offsets[at + len(p)]
                out += [(i, a, b) for i in self.piece_ids(p)]
                at += len(p)
        return out

    # decoding ------------------------------------------------------------------------------------------------

    def surface(self, ids: Iterable[int]) -> str:
        """The text of ids with space marks as spaces; runs of byte pieces are read as UTF-8."""
        out, raw = [], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                raw.append(int(self.pieces[i][1:-1], 16))
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(self.unknown_surface)
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def trim(self, text: str) -> str:
        """Without the space that normalisation put in front (all leading spaces where the model squeezes them)."""
        if self.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.dummy and text.startswith(" ") else text

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        return self.trim(self.surface(ids))


def _utf8(data: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is no part of a character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Digester:
    """ids and decoded text of whole texts through a memory of words.

    Where single spaces part the words of a text and the model takes characters as they are, a word is looked up by
    itself: as it stands for one with a space in front, behind a line feed for one at the start of a line.  Other
    texts are cut into segments first.  The spans of a word's pieces are remembered as offsets from its first source
    byte, and shifted to where the word stands.
    """

    def __init__(self, codec: Codec, most: int = MEMO):
        self.codec, self.most = codec, most
        # key -> ids of the words met lately, and of those met before that
        self.ids: dict[str, str] = {}
        self.old_ids: dict[str, str] = {}
        # key -> (first byte, end byte) of its ids from the key's own first byte, as little-endian int32; equal ones are one object
        self.rel: dict[str, bytes] = {}
        self.same_rel: dict[bytes, bytes] = {}
        self.old_rel: dict[str, bytes] = {}
        self.piece_unit: dict[str, tuple[int, int]] = {}
        #: what words decode to that do not decode to themselves
        self.odd: dict[str, str] = {}
        self.piece_text: dict[str, str] = {}
        self.piece_surface: dict[str, str] = {}
        #: pieces that do not decode to themselves
        self.odd_pieces: set[str] = set()
        self.simple = codec.cuts and codec.dummy and codec.escape and not (codec.map.units or codec.squeeze or codec.user) and not any("\n" in p for p in codec.ids)

    def words(self, text: str | None) -> list[str] | None:
        """The keys of a text's words; None if it needs segments."""
        if not text:
            return []
        if not self.simple or MARK in text or "\0" in text:
            return None
        keys = text.replace("\n", " \n").split(" ")
        return None if "" in keys else keys

    def relative(self, pieces: list[str]) -> bytes:
        """The spans of a segment's ids from its first source byte, where a space mark is one byte."""
        out, at = [], 0
        for p in pieces:
            n, size = self.piece_unit[p]
            out += (at, at + size) * n
            at += size
        return struct.pack(f"<{len(out)}i", *out)

    def spans(self, texts: list[str | None], parts: list[list[str]]) -> list[bytes]:
        """(first byte, end byte) of every id of each text as little-endian int32, in original UTF-8 bytes."""
        quick = [self.simple and not (t and MARK in t) for t in texts]
        keys = [p if q else [] for q, p in zip(quick, parts, strict=True)]
        per_text = np.fromiter(map(len, keys), np.int64, len(keys))
        found = [self.rel[k] for p in keys for k in p]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 8
        flat, ends = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2), np.cumsum(n)
        size = flat[ends - 1, 1].astype(np.int64)
        start = np.cumsum(size) - size
        first = np.cumsum(per_text) - per_text  # of each text's words
        base = np.repeat(start[np.minimum(first, len(start) - 1)], per_text) if len(start) else start
        # the space that normalisation puts in front of a text is no byte of it
        moved = flat + np.repeat((start - base - 1).astype("<i4"), n)[:, None]
        np.maximum(moved, 0, out=moved)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])].tolist()
        out = [moved[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
        for i in (i for i, q in enumerate(quick) if not q and texts[i]):
            out[i] = np.array([x[1:] for x in self.codec.spans(texts[i])], "<i4").tobytes()
        return out

    def run(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as decimals joined by commas, decoded text) of each text; null counts as empty."""
        return self.run_spans(texts)[0]

    def run_spans(self, texts: list[str | None]) -> tuple[list[tuple[int, str, str]], list[bytes]]:
        """What ``run`` and ``spans`` give."""
        codec = self.codec
        parts = [self.words(t) for t in texts]
        for k, p in enumerate(parts):
            if p is None:  # keys of segments are marked with a NUL, which is not a part of them
                parts[k] = ["\0" + x for x in codec.segments(codec.plain(texts[k]))]
        new = set().union(*parts) - self.ids.keys()
        if len(self.ids) + len(new) > self.most:
            new |= set().union(*parts)
            self.old_ids, self.ids = self.ids, {}
            self.old_rel, self.rel = self.rel, {}
            self.same_rel = {x: x for x in self.old_rel.values()}
        found = new & self.old_ids.keys()
        self.ids.update(zip(found, map(self.old_ids.__getitem__, found), strict=True))
        self.rel.update(zip(found, map(self.old_rel.__getitem__, found), strict=True))
        new = list(new - found)
        whole = [k[1:] if k[0] == "\0" else k if k[0] == "\n" else MARK + k for k in new]
        text, surface = self.piece_text, self.piece_surface
        for key, segment, pieces in zip(new, whole, codec.encode_segments(whole), strict=True):
            for p in pieces:
                if p not in text:
                    ids = codec.piece_ids(p)
                    text[p], surface[p] = ",".join(map(str, ids)), codec.surface(ids)
                    self.piece_unit[p] = len(ids), len(p.encode("utf-8", "surrogatepass")) - (len(MARK.encode()) - 1) * p.count(MARK)
                    if surface[p] != p.replace(MARK, " "):
                        self.odd_pieces.add(p)
            rel = self.relative(pieces)
            self.rel[key] = self.same_rel.setdefault(rel, rel)
            self.ids[key] = ",".join([text[p] for p in pieces])
            if self.odd_pieces and not self.odd_pieces.isdisjoint(pieces):
                decoded = "".join([surface[p] for p in pieces])
                if decoded != segment.replace(MARK, " "):
                    self.odd[key] = decoded
        out = []
        for t, p in zip(texts, parts, strict=True):
            ids = ",".join(map(self.ids.__getitem__, p))
            if p and p[0][0] == "\0" or self.odd:
                decoded = "".join([self.odd[k] if k in self.odd else k[1:].replace(MARK, " ") if k[0] == "\0" else k if k[0] == "\n" else " " + k for k in p])
                decoded = codec.trim(decoded)
            else:
                decoded = t or ""  # every word decodes to itself and the space in front of it
            out.append((ids.count(",") + 1 if ids else 0, ids, decoded))
        return out, self.spans(texts, parts)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 for every row of ``docs`` (doc_id, text).

    The ids are those of the library for the model file at ``path``, without begin and end; the decoded text is the
    library's for these ids.  The spans are the original UTF-8 bytes (first, end) that each id covers, digested as
    little-endian int32 in order.  Null and empty text have no ids and decode to an empty text.  Every row gives one
    row; nothing is shuffled.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(_model(path))  # the model file's size

    def run(batches):
        digester = Digester(Codec(shared.value))
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())])
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                rows, spans = digester.run_spans(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in spans], pa.string())], schema=schema)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def encode_spans(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, begins array<int>, ends array<int>: ids with the original UTF-8 bytes each covers."""
    shared = docs.sparkSession.sparkContext.broadcast(_model(path))

    def run(batches):
        codec = Codec(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.list_(pa.int32())) for n in ("ids", "begins", "ends")]])
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                rows = [codec.spans(t) if t else [] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([[x[k] for x in r] for r in rows], pa.list_(pa.int32())) for k in range(3)]], schema=schema)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids, decoded texts and spans of all documents."""
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
