"""Exact document deduplication by composable polynomial fingerprints, verified chunk by chunk.

A text's fingerprint is two polynomial hashes modulo primes near 2^31. Chunk hashes are computed on their own, those of
texts of several chunks as rows that Spark deals out, and combined by length-shifted arithmetic: H(AB) = H(A) x^|B| + H(B).
Rows of equal length and fingerprint are compared with the group's first row chunk by chunk; rows that differ (a
collision) form new groups, until none are left.

Texts are equal when they are identical after replacing each run of ASCII white space by one space. Null counts as
empty. Of equal texts the row with the smallest doc_id stays (a null doc_id ranks last; of rows with the same doc_id,
any one stays, and only equal texts make one go). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactgraph.llm.common import Scratch, few, keyed, numbered, texts_of

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525377)
#: Bytes of a chunk; the sum of 2^16 products of a byte and a 31-bit power fits 64 bits.
CHUNK = 1 << 16


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(CHUNK, np.uint64)
    k, step = 1, base
    while k < CHUNK:
        out[k : 2 * k] = out[:k] * np.uint64(step) % np.uint64(prime)
        k, step = 2 * k, step * step % prime
    return out[::-1].copy()


_POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


@dataclass(frozen=True)
class Fingerprint:
    length: int
    hashes: tuple[int, int]

    def __add__(self, other: Fingerprint) -> Fingerprint:
        """The fingerprint of the concatenation."""
        pairs = zip(self.hashes, other.hashes, BASES, PRIMES, strict=True)
        return Fingerprint(self.length + other.length, tuple((a * pow(x, other.length, p) + b) % p for a, b, x, p in pairs))

    @property
    def word(self) -> int:
        return self.hashes[0] << 31 | self.hashes[1]


def of_chunk(chunk: bytes) -> Fingerprint:
    """For at most CHUNK bytes. Values are one more than the byte, so that leading zero bytes count."""
    b = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(b)
    return Fingerprint(n, tuple(int(np.dot(b, w[CHUNK - n :])) % p for w, p in zip(_POWERS, PRIMES, strict=True)))


def fingerprint(text: bytes) -> Fingerprint:
    out = of_chunk(text[:CHUNK])
    for at in range(CHUNK, len(text), CHUNK):
        out += of_chunk(text[at : at + CHUNK])
    return out


_WHITE = frozenset(b" \t\n\r\x0b\x0c")


def normalise(text: bytes) -> bytes:
    words = text.split()
    if not words:
        return b" " if text else b""
    return b" " * (text[0] in _WHITE) + b" ".join(words) + b" " * (text[-1] in _WHITE)


_PRINT = "row_key long, doc_id long, n_bytes long, fp long, text_sha256 string"


def _prints(docs: DataFrame) -> DataFrame:
    """A fingerprint and a digest of every text. Texts of one chunk are hashed where they are read; chunks of longer ones
    are rows of their own, of which only a length, two hashes and two shifts return."""
    long = F.octet_length("text") > CHUNK
    one = docs.where(~long).mapInArrow(_fingerprints, _PRINT)
    text = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    digests = docs.where(long).select("row_key", "doc_id", F.sha2(text, 256).alias("text_sha256"))
    parts = docs.where(long).select("row_key", "text").mapInArrow(lambda it: _batched(_parts(it)), "row_key long, part int, chunk binary")
    hashed = parts.repartition("row_key", "part").mapInArrow(_chunk_hashes, "row_key long, part int, n long, h0 long, h1 long, s0 long, s1 long")
    listed = hashed.groupBy("row_key").agg(F.sum("n").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("part", "h0", "h1", "s0", "s1"))).alias("parts"))

    def joined(t: int) -> Column:
        prime = F.lit(PRIMES[t]).cast("long")
        return F.aggregate("parts", F.lit(0).cast("long"), lambda h, x: F.pmod(h * x[f"s{t}"] + x[f"h{t}"], prime))

    many = listed.select("row_key", "n_bytes", F.shiftleft(joined(0), 31).bitwiseOR(joined(1)).alias("fp"))
    return one.unionByName(digests.join(many, "row_key"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, t in zip(batch.column("row_key").to_pylist(), texts_of(batch.column("text")), strict=True):
            t = normalise(t)
            parts = [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)] or [b""]
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["row_key", "part", "chunk"])


def _chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n", "h0", "h1", "s0", "s1"]
    for batch in batches:
        prints = [of_chunk(c) for c in batch.column("chunk").to_pylist()]
        cols = [[f.length for f in prints], *([f.hashes[t] for f in prints] for t in (0, 1)), *([pow(BASES[t], f.length, PRIMES[t]) for f in prints] for t in (0, 1))]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("part"), *(pa.array(c, pa.int64()) for c in cols)], names=["row_key", "part", *names])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in texts_of(batch.column("text")):
            t = normalise(t)
            f = fingerprint(t)
            rows.append((f.length, f.word, hashlib.sha256(t).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["row_key", "doc_id", "n_bytes", "fp", "text_sha256"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r, h, t in zip(batch.column("row_key").to_pylist(), batch.column("head").to_pylist(), texts_of(batch.column("text")), strict=True):
            t = normalise(t)
            parts = [t[i : i + CHUNK] for i in range(0, len(t), CHUNK)] or [b""]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([r] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=["row_key", "head", "part", "chunk"])


def _batched(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    return _classes(keyed(docs, scratch), scratch).drop("row_key")


def _classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """classes() with row_key, of docs as `keyed` has them.

    Per document two hashes, a length and a digest are shuffled; texts move only for documents that have a twin.
    """
    prints = scratch.write(_prints(docs), "prints")
    rank = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank"), "row_key", "doc_id")
    open_, members, turn = prints.select("row_key", "doc_id", "n_bytes", "fp"), None, 0
    while True:
        heads = open_.groupBy("n_bytes", "fp").agg(F.min(rank).alias("head"), F.count("*").alias("n")).where("n > 1")
        heads = scratch.write(heads, f"heads{turn}")  # so that the join can split a large group
        twins = scratch.write(open_.join(heads, ["n_bytes", "fp"]).select("row_key", open_.doc_id, "n_bytes", "fp", F.col("head.row_key").alias("head"), F.col("head.doc_id").alias("keep_id")), f"twins{turn}")
        if twins.isEmpty():
            break
        want = twins.select("row_key", "head")
        want = F.broadcast(want) if few(twins) else want
        chunks = docs.select("row_key", "text").join(want, "row_key").mapInArrow(lambda it: _batched(_chunks(it)), "row_key long, head long, part int, chunk binary")
        chunks = scratch.write(chunks, f"chunks{turn}")
        first = chunks.where("row_key = head").select("head", "part", F.col("chunk").alias("other"))
        differ = chunks.where("row_key <> head").join(first, ["head", "part"], "left").where(~F.col("chunk").eqNullSafe(F.col("other"))).select("row_key").distinct()
        differ = scratch.write(differ, f"differ{turn}")
        scratch.drop(f"chunks{turn}")
        same = twins.join(differ, "row_key", "left_anti").select("row_key", "head", "keep_id") if not differ.isEmpty() else twins.select("row_key", "head", "keep_id")
        members = same if members is None else members.unionByName(same)
        if differ.isEmpty():
            break
        open_, turn = twins.join(differ, "row_key", "left_semi").select("row_key", "doc_id", "n_bytes", "fp"), turn + 1
    if members is None:
        return prints.select("row_key", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    sizes = scratch.write(members.groupBy("head").agg(F.count("*").alias("group_size")), "sizes")
    found = members.join(sizes, "head")
    alone = F.col("head").isNull()
    return prints.join(found, "row_key", "left").select(
        "row_key", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("head") == F.col("row_key"))).alias("kept"), "text_sha256",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with all columns of docs."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = numbered(docs, scratch)
    keys = rows.select("row_key", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))
    gone = scratch.write(_classes(keys, scratch).where("NOT kept").select("row_key"), "gone")
    return rows.join(F.broadcast(gone) if few(gone) else gone, "row_key", "left_anti").select("doc.*")
