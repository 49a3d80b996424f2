"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes are put into buckets of equal q-grams, and a bucket is refined by the bucket identifiers at later offsets:
positions with equal identifiers at p and at p + d share the next d bytes too. Positions alone in their bucket drop out
before each round, and a round's identifiers are those that the next one reuses. Here suffixes are first parted by anchors
(see `runs`), over the whole corpus. Within an anchor the first buckets are of GRAM bytes, as they are, and are refined
from 8 to 16 to 32 bytes and so on, without hashes. Anchors of more than LOCAL distinct contexts don't fit one task:
Spark aggregates rows of blocks of windows for them, and then of the windows of those blocks that are neither repeated
as a whole nor unique. Both ways give the same strings.

Every byte covered by a string of K bytes that also starts anywhere else, in the same document or another, is removed;
overlaps count, and strings are judged on the input. Strings never cross documents. Null text is empty. Repeated rows
are documents of their own, so that each has the other's strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm import hashing, runs
from impactgraph.llm.common import Scratch, keyed, texts_of

#: Bytes of a string, and of an anchor.
K, Q = 200, 32
#: Bytes of the first buckets; contexts of one anchor that a single task compares; windows of a block.
GRAM, LOCAL, BLOCK = 8, 256, 20

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

#: Bytes of a text that are hashed at a time; pieces overlap by K + PIECE bytes less one window.
PIECE = 1 << 20


def _runs(k: int, q: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, got, of = np.asarray(batch.column("row_key")), texts_of(batch.column("text")), [], []
            for key, text in zip(keys, texts, strict=True):
                for at in range(0, max(1, len(text) - k + 1), PIECE):  # a piece has the windows that start in it
                    piece = text[at : at + PIECE + k - 1]
                    if len(piece) >= k:
                        a, s, e = runs.find(hashing.byte_prefix(piece), 0, len(piece), k, q)
                        got.append((a, np.array(runs.contexts(piece, s, e, k)), s + at, e + at))
                        of.append(np.full(len(a), key))
            if got:
                a, c, s, e = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([runs.signed(a), pa.array(c), pa.array(np.concatenate(of)), pa.array(s), pa.array(e)], names=["q", "c", "row_key", "p0", "p1"])

    return rows


def _contexts(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, wanted in zip(batch.column("row_key").to_pylist(), texts_of(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x["q"] for x in wanted]), pa.array([x["n"] for x in wanted]), pa.array([key] * len(wanted), pa.int64()), pa.array([x["p0"] for x in wanted]), pa.array([x["contexts"] for x in wanted]), pa.array([text[x["p0"] : x["p1"] + k] for x in wanted], pa.binary())], names=["q", "n", "row_key", "p0", "contexts", "bytes"])

    return rows


_CONTEXT = "q long, n long, row_key long, p0 long, contexts long, bytes binary"
_SPAN = "row_key long, s long, e long"


def refine(group: np.ndarray, texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of k bytes that two places of one group start: (context, place there) of each."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.concatenate([[0], np.cumsum(size)])
    span = np.repeat(np.arange(len(texts)), size)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    have = min(GRAM, k)
    key = np.zeros(max(0, len(data) - have + 1), np.uint64)
    for j in range(have):
        key = key << np.uint64(8) | data[j : j + len(key)]
    pos = np.flatnonzero(span[: len(key)] == span[have - 1 :])
    gram = np.unique(key[pos], return_inverse=True)[1]
    key = np.unique(group, return_inverse=True)[1][span[pos]] * np.int64(len(pos) + 1) + gram
    while True:
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[inverse] > 1  # a string alone in its bucket is in no larger bucket either
        bucket = np.full(len(span), -1, np.int64)
        pos = pos[many]
        bucket[pos] = inverse[many]
        if have == k:
            return span[pos], pos - base[span[pos]]
        step = min(have, k - have)  # the last step may overlap
        pos = pos[pos + step + have <= len(span)]
        pos = pos[(bucket[pos + step] >= 0) & (span[pos + step + have - 1] == span[pos])]
        key = bucket[pos] * np.int64(len(count) + 1) + bucket[pos + step]
        have += step


def _joined(rows: np.ndarray, p0: np.ndarray, of: np.ndarray, at: np.ndarray, k: int) -> pa.RecordBatch:
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]) if len(of) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(rows[of[first]]), pa.array(p0[of[first]] + at[first]), pa.array(p0[of[first]] + at[last] + k)], names=["row_key", "s", "e"])


def _spans(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs.whole_groups(batches, "q", "bytes"):
            q, n, key, p0 = (t.column(x).to_numpy() for x in ("q", "n", "row_key", "p0"))
            of, at = refine(q, t.column("bytes").to_pylist(), k)
            own = n[of] == 1
            yield _joined(key, p0, of[own], at[own], k)

    return rows


def blocks(text: bytes, anchor: int, k: int, q: int, size: int) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """Windows of one context in blocks of `size` by their distance to its anchor, so that contexts of one anchor agree.

    For each block: (number, core, span, first window, window hashes). The core is what all windows of a whole block cover
    and lies within any of them; where the core occurs once, so do they. Where a block's span, all that its windows
    cover, occurs twice, so do they.
    """
    last = len(text) - k
    least = hashing.windows(hashing.byte_prefix(text), q)[last:]
    a = last + int(np.flatnonzero(least.view(np.int64) == anchor)[0])
    for j in range((a - last) // size, a // size + 1):
        lo, hi = max(0, a - (j * size + size - 1)), min(last, a - j * size)
        core = hashing.digest(text[a - j * size : a - (j * size + size - 1) + k])
        span = hashing.digest(b"%d %d %d " % (j, hi - lo, a - hi) + text[lo : hi + k])
        yield j, core, span, lo, [hashing.digest(text[i : i + k]) for i in range(lo, hi + 1)]


_BLOCK = "q long, n long, row_key long, j int, core long, span long, at long, hs array<long>"


def _block_rows(k: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, n, key, p0, text in zip(*(b.column(x).to_pylist() for x in ("q", "n", "row_key", "p0", "bytes")), strict=True):
                out += [(q, n, key, j, core, span, p0 + at, hs) for j, core, span, at, hs in blocks(text, q, k, gram, BLOCK)]
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["q", "n", "row_key", "j", "core", "span", "at", "hs"])

    return rows


def _large(scratch: Scratch, texts: DataFrame, k: int, q: int) -> DataFrame:
    """Repeated strings among the contexts of large buckets, refined from cores to spans to single windows."""
    rows = texts.repartition("row_key", "p0").mapInArrow(_block_rows(k, q), _BLOCK)
    rows = scratch.write(rows, "blocks")
    cores = rows.groupBy("q", "j", "core").agg(F.count("*").alias("times")).where("times > 1").select("q", "j", "core")
    cores = scratch.write(cores, "core-keys")
    rows = scratch.write(rows.join(cores, ["q", "j", "core"]), "cores")
    spans = rows.groupBy("q", "span").agg(F.count("*").alias("times"), F.min(F.struct("row_key", "at")).alias("one")).where("times > 1")
    spans = scratch.write(spans, "span-keys")
    rows = scratch.write(rows.join(spans, ["q", "span"], "left"), "spans")
    whole = rows.where("times > 1 AND n = 1").select("row_key", F.col("at").alias("s"), (F.col("at") + F.size("hs") - 1 + k).alias("e"))
    # A block that is repeated as a whole is compared further by one of its copies.
    single = rows.where("times IS NULL OR (row_key = one.row_key AND at = one.at)").select("q", "n", "row_key", "times", "at", F.posexplode("hs").alias("i", "h"))
    twice = single.groupBy("q", "h").agg(F.count("*").alias("seen")).where("seen > 1").select("q", "h")
    part = single.where("n = 1 AND times IS NULL").join(twice, ["q", "h"]).select("row_key", (F.col("at") + F.col("i")).alias("s"), (F.col("at") + F.col("i") + k).alias("e"))
    return whole.unionByName(part)


def marks(scratch: Scratch, docs: DataFrame, k: int = K, q: int = Q) -> DataFrame:
    """(row_key, s, e): spans of bytes to remove."""
    found = docs.select("row_key", "text").mapInArrow(_runs(k, q), "q long, c long, row_key long, p0 long, p1 long")
    found = runs.shared(scratch, scratch.write(found, "runs"))
    scratch.drop("runs")
    same = found.groupBy("q", "c").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "p0", "p1")).alias("first"))
    same = scratch.write(same.select("q", "c", "n", "first.*"), "contexts")
    groups = same.groupBy("q").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 AND least = 1").drop("least")
    groups = scratch.write(groups, "groups")
    wanted = scratch.write(same.join(groups, "q").drop("c"), "wanted")
    texts = scratch.write(runs.with_texts(scratch, docs, wanted, _contexts(k), _CONTEXT), "texts")
    scratch.drop("wanted", "wanted-keys")
    small = texts.where(F.col("contexts") <= LOCAL).repartition("q").sortWithinPartitions("q").mapInArrow(_spans(k), _SPAN)
    large = _large(scratch, texts.where(F.col("contexts") > LOCAL), k, q)
    whole = found.join(same.where("n > 1").select("q", "c"), ["q", "c"]).select("row_key", F.col("p0").alias("s"), (F.col("p1") + k).alias("e"))
    return scratch.write(small.unionByName(large).unionByName(whole), "marks")


def removed(docs: DataFrame, k: int = K, q: int = Q) -> DataFrame:
    """One row per document, as SCHEMA has it."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    docs = keyed(docs, scratch)

    def digest(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
        if not len(s):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        gone = runs.covered(s, e, len(text))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()

    return runs.apply(scratch, docs, marks(scratch, docs, k, q), digest, SCHEMA)
