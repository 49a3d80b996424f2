"""Substring deduplication over words by relative Lempel-Ziv parsing.

The reference blocks are the contexts (see `runs`) of all documents, each of at most 2 K - q words; every window of K words
of every block is in the index, under its anchor, at the place of its earliest document. A document's context is
factored greedily: at the cursor the index names a block of an earlier document that holds the window there; the factor is
extended along that block as far as the words agree; the cursor then moves to the first window that crosses the factor's
end, which the index is asked for again. So every window is looked up, but for those inside a factor. Factors are checked
word by word, and those of K words or more become spans. A context that an earlier document has as a whole is one factor.

Words are runs of characters other than ASCII white space, unchanged. Every word covered by a window of K words whose
word sequence also starts in a document with a smaller doc_id is removed; windows are judged on the input. Null texts
have no words. A null doc_id ranks after all others; rows with equal ids never remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm import hashing, runs
from impactgraph.llm.common import Scratch, keyed, slices, texts_of

#: Words of a window and of an anchor.
K, Q = 50, 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _runs(k: int, q: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranks = np.asarray(batch.column("row_key")), np.asarray(batch.column("rank"))
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                w = hashing.Words(texts[a:b])
                p = hashing.prefix(w.hash)
                got = [runs.find(p, lo, hi, k, q) for lo, hi in zip(w.first, w.first[1:], strict=False)]
                size = [len(g[0]) for g in got]
                cols = [np.concatenate(x) for x in zip(*got, strict=True)]
                lo = np.repeat(w.first[:-1], size)
                c = runs.contexts(w.hash.tobytes(), cols[1] + lo, cols[2] + lo, k, 8)
                yield pa.RecordBatch.from_arrays([runs.signed(cols[0]), pa.array(c, pa.int64()), pa.array(np.repeat(keys[a:b], size)), pa.array(np.repeat(ranks[a:b], size)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32))], names=["q", "c", "row_key", "rank", "p0", "p1"])

    return rows


def _contexts(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(texts_of(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                w = text.split()
                yield pa.RecordBatch.from_arrays([pa.array([x["q"] for x in wanted]), pa.array([x["c"] for x in wanted]), pa.array([x["rank"] for x in wanted]), pa.array([b" ".join(w[x["p0"] : x["p1"] + k]) for x in wanted], pa.binary())], names=["q", "c", "rank", "words"])

    return rows


_CONTEXT = "q long, c long, rank long, words binary"
_FACTOR = "q long, c long, s long, e long"


def _windows(k: int):
    """(q, c, rank, at, h) of every window of each block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("words").to_pylist()
            for a, b in slices(texts):
                per = [hashing.word_hashes(t).tobytes() for t in texts[a:b]]
                size = np.array([len(p) // 8 - k + 1 for p in per])
                h = [hashing.digest(p[8 * i : 8 * (i + k)]) for p, n in zip(per, size, strict=True) for i in range(n)]
                own = [pa.array(np.repeat(np.asarray(batch.column(x))[a:b], size)) for x in ("q", "c", "rank")]
                at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), pa.array(h, pa.int64())], names=["q", "c", "rank", "at", "h"])

    return rows


def parse(words: list[bytes], found: list[tuple[int, int, list[bytes]]], k: int) -> Iterator[tuple[int, int]]:
    """Factors [s, e) of a context. found: (place, place in the block, the block's words) as the index has them."""
    blocks = {at: (to, block) for at, to, block in found}
    cursor = 0
    while cursor + k <= len(words):
        to, block = blocks.get(cursor, (0, ()))
        n = 0
        while cursor + n < len(words) and to + n < len(block) and words[cursor + n] == block[to + n]:
            n += 1
        if n >= k:
            yield cursor, cursor + n
            cursor += n - k + 1
        else:
            cursor += 1


def _factors(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, c, words, found, blocks in zip(*(batch.column(x).to_pylist() for x in ("q", "c", "words", "found", "blocks")), strict=True):
                held = {x["rc"]: x["block"].split() for x in blocks}
                own = [(x["at"] + i, x["to"] + i, held[x["rc"]]) for x in found for i in range(x["n"])]
                out += [(q, c, s, e) for s, e in parse(words.split(), own, k)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 4)], names=["q", "c", "s", "e"])

    return rows


def _parsed(scratch: Scratch, texts: DataFrame, k: int) -> DataFrame:
    """Factors of all contexts. What is gathered for one of them is bounded by the windows that it has."""
    windows = scratch.write(texts.mapInArrow(_windows(k), "q long, c long, rank long, at int, h long"), "windows")
    index = windows.groupBy("q", "h").agg(F.min(F.struct("rank", "c", "at")).alias("x"), F.max("rank").alias("most")).where("x.rank < most")
    index = scratch.write(index.select("q", "h", F.col("x.rank").alias("least"), F.col("x.c").alias("rc"), F.col("x.at").alias("to")), "index")
    hits = windows.join(index, ["q", "h"]).where("least < rank").select("q", "c", "at", "rc", "to")
    # Windows that stand side by side in a context and in its block are one row.
    diagonal = hits.groupBy("q", "c", "rc", (F.col("to") - F.col("at")).alias("shift")).agg(F.array_sort(F.collect_list("at")).alias("ats"))
    steps = F.transform("ats", lambda at, i: F.struct((at - i).alias("run"), at.alias("at")))
    runs_ = F.transform(F.array_distinct(F.transform(steps, lambda x: x["run"])), lambda r: F.struct(F.array_min(F.transform(F.filter(steps, lambda x: x["run"] == r), lambda x: x["at"])).alias("at"), F.size(F.filter(steps, lambda x: x["run"] == r)).alias("n")))
    found = scratch.write(diagonal.select("q", "c", "rc", F.transform(runs_, lambda x: F.struct(x["at"].alias("at"), (x["at"] + F.col("shift")).alias("to"), x["n"].alias("n"), F.col("rc").alias("rc"))).alias("found")), "found")
    scratch.drop("windows", "index")
    block = texts.select("q", F.col("c").alias("rc"), F.col("words").alias("block"))
    per = found.join(block, ["q", "rc"]).groupBy("q", "c").agg(F.flatten(F.collect_list("found")).alias("found"), F.collect_set(F.struct("rc", "block")).alias("blocks"))
    return per.join(texts.select("q", "c", "words"), ["q", "c"]).select("q", "c", "words", "found", "blocks").mapInArrow(_factors(k), _FACTOR)


def marks(scratch: Scratch, docs: DataFrame, k: int = K, q: int = Q) -> DataFrame:
    """(row_key, s, e): spans of words to remove."""
    rank = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank")
    found = docs.select("row_key", rank, "text").mapInArrow(_runs(k, q), "q long, c long, row_key long, rank long, p0 int, p1 int")
    found = runs.shared(scratch, scratch.write(found, "runs"))
    scratch.drop("runs")
    same = found.groupBy("q", "c").agg(F.min(F.struct("rank", "row_key", "p0", "p1")).alias("first"))
    same = scratch.write(same.select("q", "c", "first.*"), "contexts")
    groups = scratch.write(same.groupBy("q").agg(F.count("*").alias("contexts")).where("contexts > 1").select("q"), "groups")
    wanted = scratch.write(same.join(groups, "q"), "wanted")
    texts = scratch.write(runs.with_texts(scratch, docs, wanted, _contexts(k), _CONTEXT), "texts")
    scratch.drop("wanted", "wanted-keys")
    factors = scratch.write(_parsed(scratch, texts, k), "factors")
    earliest = same.select("q", "c", F.col("rank").alias("least"))
    later = found.join(earliest, ["q", "c"])
    whole = later.where("rank > least").select("row_key", F.col("p0").cast("long").alias("s"), (F.col("p1") + k).cast("long").alias("e"))
    part = later.where("rank = least").join(factors, ["q", "c"]).select("row_key", (F.col("p0") + F.col("s")).alias("s"), (F.col("p0") + F.col("e")).alias("e"))
    return scratch.write(whole.unionByName(part), "marks")


def removed(docs: DataFrame, k: int = K, q: int = Q) -> DataFrame:
    """One row per document, as SCHEMA has it."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = keyed(docs, scratch)

    def digest(text: bytes, s: np.ndarray, e: np.ndarray) -> tuple:
        words = text.split()
        if not len(s):
            return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
        gone = runs.covered(s, e, len(words))
        return len(words), int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest()

    return runs.apply(scratch, docs, marks(scratch, docs, k, q), digest, SCHEMA)
