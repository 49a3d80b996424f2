"""Simple-8b: unsigned integers packed into 64-bit words, a varying count in each.

The top 4 bits of a word are its selector, the low 60 bits hold COUNTS[selector] values of 60 // count bits each. The
selector ESCAPE says that the whole next word is one value of over 60 bits. Ids are packed in blocks of BLOCK values;
each block starts a new word, and its word offset is kept, so that blocks can be decoded alone and side by side.

Packing and unpacking are vectorised: the greedy choice of a selector is found for every position at once by running
maxima, and the chains of word starts of all blocks are followed together.
"""

from __future__ import annotations

import numpy as np

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 1024

_U = np.uint64
#: Bits of values under 2^16, which token ids mostly are.
_SHORT = np.maximum(1, np.ceil(np.log2(np.arange(1, (1 << 16) + 1)))).astype(np.uint8)


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs, at least 1."""
    if len(v) and v.max() < len(_SHORT):
        return _SHORT[v.astype(np.intp)]
    w = np.ones(len(v), np.uint8)
    rest, shift = v.copy(), 32
    while shift:
        big = rest >= (_U(1) << _U(shift))
        w[big] += shift
        rest[big] >>= _U(shift)
        shift //= 2
    return w


def _choices(width: np.ndarray) -> np.ndarray:
    """For each position the first selector whose values from there all fit; width has 60 entries of 255 behind it."""
    n = len(width) - 60
    best = np.full(n, ESCAPE, np.uint8)
    best[width[:n] <= 60] = len(COUNTS) - 1
    most, k = width, 1
    for s in range(len(COUNTS) - 2, -1, -1):
        c = COUNTS[s]
        while k < c:  # widen the running maximum from k to c values
            step = min(k, c - k)
            most = np.maximum(most[:-step], most[step:])
            k += step
        best[most[:n] <= 60 // c] = s
    return best


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end)."""
    words, blocks, edges = pack_many(values, np.array([len(values)]), block)
    return words, np.append(blocks, len(words))


def pack_many(values: np.ndarray, sizes: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of the given sizes, one behind the other, packed at once.

    (words, word offset of each block, edges): words and blocks of sequence i are those from edges[0][i] and edges[1][i]
    up to the next edge. A sequence without values has neither.
    """
    v, sizes = np.asarray(values, _U), np.asarray(sizes, np.int64)
    n_blocks = -(-sizes // block)
    of = np.repeat(np.arange(len(sizes)), n_blocks)
    first_block = np.concatenate([[0], np.cumsum(n_blocks)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    inside = (np.arange(len(of)) - first_block[of]) * block
    starts = begin[of] + inside
    size = np.minimum(block, sizes[of] - inside)
    if not len(of):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros((2, len(sizes) + 1), np.int64)
    # A value that never fits stands between blocks, so that no word crosses from one to the next.
    shift = np.repeat(np.arange(len(of)), size)
    width = np.full(len(v) + len(of) + 60, 255, np.uint8)
    width[np.arange(len(v)) + shift] = _widths(v)
    choice = _choices(width)
    counts = np.array([*COUNTS, 1, 1])
    where, end, found = starts + np.arange(len(of)), starts + np.arange(len(of)) + size, []
    while len(where):
        found.append(where)
        where = where + counts[choice[where]]
        more = where < end
        where, end = where[more], end[more]
    padded = np.sort(np.concatenate(found))
    sel = choice[padded]
    place = np.concatenate([[0], np.cumsum(1 + (sel == ESCAPE))])
    blocks = place[np.searchsorted(padded, starts + np.arange(len(of)))]
    first = padded - np.searchsorted(starts + np.arange(len(of)), padded, "right") + 1
    words = sel.astype(_U) << _U(60)
    out = np.zeros(place[-1], _U)
    for s, c in enumerate(COUNTS):
        at = np.flatnonzero(sel == s)
        if len(at):
            bits = 60 // c
            w = words[at]
            for j in range(c):
                w |= v[first[at] + j] << _U(j * bits)
            words[at] = w
    out[place[:-1]] = words
    at = np.flatnonzero(sel == ESCAPE)
    out[place[at] + 1] = v[first[at]]
    return out, blocks, np.stack([np.append(blocks, len(out))[first_block], first_block])


def unpack(words: np.ndarray, n: int, blocks: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """The n values that were packed.

    blocks and sizes: the word offset and the number of values of each block. All blocks are decoded side by side from
    their offsets; without them the words are read as one block. Offsets that the words don't bear out raise.
    """
    words = np.asarray(words, _U)
    blocks = np.zeros(min(1, len(words)), np.int64) if blocks is None else np.asarray(blocks, np.int64)
    sizes = np.full(len(blocks), n) if sizes is None else sizes
    if len(blocks) and (blocks[0] or blocks[-1] >= len(words) or (np.diff(blocks) <= 0).any()):
        raise ValueError("block offsets aren't within the words")
    sel = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():  # the word behind an escape is no selector, whatever its bits; so go from word to word in each block
        at, end = blocks, np.append(blocks[1:], len(words))
        while len(at):
            escaped = sel[at] == ESCAPE
            if (at[escaped] + 1 >= end[escaped]).any():
                raise ValueError("a block ends behind an escape")
            raw[at[escaped] + 1] = True
            at = at + 1 + escaped
            at, end = at[at < end], end[at < end]
    counts = np.array([*COUNTS, 0, 0])[sel]
    counts[raw] = 1
    place = np.concatenate([[0], np.cumsum(counts)])
    if (np.diff(np.append(place[blocks], place[-1])) != sizes).any() or place[-1] != n:
        raise ValueError(f"the words hold {place[-1]} values where {n} were packed, or a block's offset is wrong")
    out = np.zeros(place[-1], _U)
    out[place[:-1][raw]] = words[raw]
    for s, c in enumerate(COUNTS):
        at = np.flatnonzero((sel == s) & ~raw)
        if len(at):
            bits = 60 // c
            for j in range(c):
                out[place[at] + j] = (words[at] >> _U(j * bits)) & _U((1 << bits) - 1)
    return out
