"""Hashes of words, of word sequences and of byte strings.

Words and strings have XXH3 hashes, which have no rule by which unlike ones meet. Polynomials modulo 2^64 have one (words like
abba... and its complement meet), so that they choose anchors only, where it is enough that equal strings get equal hashes. With prefix sums P[i] = sum_{j<i} v_j B^j, that of a span is
(P[e] - P[s]) B^-s: it depends on the span's content alone, so that chunks, documents and tasks agree on it.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
WHITE = b" \t\n\r\x0b\x0c"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One 64-bit word for each byte value.
BYTE_WORD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = np.uint64(pow(self.base, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * step])
        return self.table[:n]


_up, _down = _Powers(BASE), _Powers(_INVERSE)


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _up.upto(len(values)), out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((p[end] - p[start]) * _down.upto(len(p))[start])


def windows(p: np.ndarray, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Hash of each run of k consecutive values among values [first, last)."""
    last = len(p) - 1 if last is None else last
    n = last - first - k + 1
    return mix((p[first + k : last + 1] - p[first : first + n]) * _down.upto(first + n)[first:]) if n > 0 else np.zeros(0, np.uint64)


def byte_prefix(text: bytes) -> np.ndarray:
    return prefix(BYTE_WORD[np.frombuffer(text, np.uint8)])


def slide_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w consecutive values, by doubling."""
    k, m = 1, h
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(m) - (w - k)], m[w - k :]) if k < w else m


_hash_of = xxhash.xxh3_64_intdigest
_SPACE = re.compile(rb"[ \t-\r]")
_PIECE = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, split piece by piece, so that no list has all words of a long one."""
    if len(text) <= _PIECE:
        words = text.split()
        return np.fromiter(map(_hash_of, words), np.uint64, len(words))
    out, at = [], 0
    while at < len(text):
        m = _SPACE.search(text, min(len(text), at + _PIECE))
        end = m.end() if m else len(text)
        words = text[at:end].split()
        out.append(np.fromiter(map(_hash_of, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out)


def digest(x: bytes) -> int:
    """Signed 64-bit XXH3."""
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes: sums of products with odd factors of their own, mixed."""
    k = len(words) - n + 1
    factor = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    h = words[:k] * factor[0]
    for j in range(1, n):
        h += words[j : j + k] * factor[j]
    return mix(h ^ np.uint64(n))


class Words:
    """Words of some texts: byte bounds, 64-bit hashes, and the text of each.

    `table` maps bytes before splitting; bytes that it maps to a space part words.
    """

    def __init__(self, texts: list[bytes], table: bytes | None = None):
        self.joined = b" ".join(texts) + b" "
        if table:
            self.joined = self.joined.translate(table)
        buf = np.frombuffer(self.joined, np.uint8)
        solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = word_hashes(self.joined)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(size)
        #: Words [first[i], first[i + 1]) are those of text i.
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.offset = ends - size
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j joined by one space."""
        return b" ".join(self.joined[s:e] for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True))


def lower_ascii() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
