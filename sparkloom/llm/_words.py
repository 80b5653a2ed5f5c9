"""Words, windows and shingles of many texts at once, under names made by hashing their content.

A word's name are 128 bits in two halves: of up to 15 bytes, a one-to-one scramble of the bytes and their number; of
more, their keyed BLAKE2 digest.  Windows and shingles have two 64-bit names made from one half each, so what is equal
by both is equal by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

_MUL, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INV = pow(_MUL, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Words of so many bytes are scrambled, longer ones digested; distinct long words that a worker remembers.
SHORT, MEMO = 15, 100_000
#: What is kept of eight bytes that begin a word of n bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class _Names(dict):
    """long word -> its row in a table of names."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.digests += hashlib.blake2b(word, digest_size=16, key=b"sparkloom words").digest()
        return at

    def table(self) -> np.ndarray:
        return np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)

    def forget(self) -> None:
        self.clear()
        self.digests = bytearray()


_names = _Names()


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MUL, _INV)):
            out = np.full(n + n // 4, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x + np.uint64(salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first names, second names of all words in order, first word of each text and the end)."""
    if len(_names) > MEMO:
        _names.forget()
    data = b" ".join([b"", *texts, b" " * 16])
    byte = np.frombuffer(data, np.uint8)
    space = (byte == 32) | (byte - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    first = np.searchsorted(start, np.cumsum([1, *[len(t) + 1 for t in texts]]))
    load = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    short = np.minimum(size, SHORT)
    one = load[start] & _KEEP[np.minimum(short, 8)]
    two = load[start + 8] & _KEEP[np.maximum(short - 8, 0)] | short.astype(np.uint64) << np.uint64(56)
    for salt in (60, 62):
        two ^= mix(one, salt)
        one ^= mix(two, salt + 1)
    at = np.flatnonzero(size > SHORT)
    if len(at):
        rows = [_names[data[a:b]] for a, b in zip(start[at].tolist(), (start + size)[at].tolist(), strict=True)]
        one[at], two[at] = _names.table()[rows].T
    return one, two, first


def window_names(name: np.ndarray, width: int) -> np.ndarray:
    """The name of the window of ``width`` words that starts at each word (the caller sees to text ends)."""
    n = len(name) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = mix(np.arange(width, dtype=np.uint64), 90 + width) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += name[k : k + n] * factor[k]
    return mix(total, 1)


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted."""
    order = np.argsort(one)
    one, two = one[order], two[order]
    new = np.concatenate([[True], one[1:] != one[:-1]])
    if (~new[1:] & (two[1:] != two[:-1])).any():
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    return one[new], two[new]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two names of the distinct shingles of each text, sorted; a text of fewer words is one shingle of them all."""
    one, two, first = words(texts)
    long_one, long_two, out = window_names(one, width), window_names(two, width), []
    nothing = np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(_distinct(long_one[a : b - width + 1], long_two[a : b - width + 1]))
        elif b > a:
            out.append((window_names(one[a:b], b - a), window_names(two[a:b], b - a)))
        else:
            out.append((nothing, nothing))
    return out


def shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share, by both names."""
    small, large = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    if not len(small[0]):
        return 0
    at = np.searchsorted(large[0], small[0])
    at[at == len(large[0])] = 0
    same = large[0][at] == small[0]
    if (same & (large[1][at] != small[1])).any():
        return len({*zip(*map(np.ndarray.tolist, small), strict=True)} & {*zip(*map(np.ndarray.tolist, large), strict=True)})
    return int(same.sum())
