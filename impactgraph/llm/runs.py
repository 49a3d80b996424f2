"""Repeated windows of a corpus, found through runs of windows that share their least gram.

A window is K consecutive units (bytes or words). The least hash of its q-grams is its anchor; equal windows have equal
anchors, and consecutive windows with one anchor form a run. Over a corpus there is a run for about every
(K - q + 2) / 2 windows, so that runs can be shuffled where windows can't. A run has two keys: `q`, its anchor, and
`c`, the hash of all that its windows cover. Windows whose run shares `q` with no other are unique. Runs with equal `c`
have the same windows. What remains are distinct contexts of one anchor, of at most 2 K - q units each, whose windows are
compared by the operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm import hashing
from impactgraph.llm.common import Scratch, few

def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def find(p: np.ndarray, first: int, last: int, k: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs among units [first, last) of prefix sums p: anchors, first and last window of each."""
    if last - first < k:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    h = hashing.windows(p, q, first, last)
    m = hashing.slide_min(h, k - q + 1)
    # A run ends where the least hash changes, and behind a window that begins with it: the next one's is another place.
    cut = np.flatnonzero((m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])) + 1
    s, e = np.concatenate([[0], cut]), np.concatenate([cut, [len(m)]]) - 1
    return m[s], s, e


def contexts(data: bytes, s: np.ndarray, e: np.ndarray, k: int, width: int = 1) -> list[int]:
    """Hash of all that the windows of each run cover; data has `width` bytes a unit."""
    return [hashing.digest(data[a:b]) for a, b in zip((s * width).tolist(), ((e + k) * width).tolist(), strict=True)]


def shared(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """The runs whose anchor another run has too.

    Counts are written before they are joined, here and below: the join then deals both sides anew and can split a
    partition that one frequent anchor fills.
    """
    twice = scratch.write(runs.groupBy("q").agg(F.count("*").alias("n")).where("n > 1").select("q"), "anchors")
    return scratch.write(runs.join(twice, "q"), "shared")


def with_texts(scratch: Scratch, docs: DataFrame, wanted: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """cut() over each document that `wanted` names, with its list of wanted rows; texts of others don't move."""
    keys = scratch.write(wanted.select("row_key").distinct(), "wanted-keys")
    if few(keys):
        docs = docs.join(F.broadcast(keys), "row_key", "left_semi")
    fields = [c for c in wanted.columns if c != "row_key"]
    per_doc = wanted.groupBy("row_key").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    return docs.select("row_key", "text").join(per_doc, "row_key").mapInArrow(cut, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, size: str, most: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of complete groups of rows that are sorted by key, each of about `most` bytes of the column `size`."""
    held: list[pa.RecordBatch] = []
    amount = 0

    def ready(end: bool) -> Iterator[pa.Table]:
        nonlocal held, amount
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(key).to_numpy()
        stop = len(k) if end else int(np.searchsorted(k, k[-1]))
        edges = np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))
        weight = np.concatenate([[0], np.cumsum(t.column(size).combine_chunks().cast(pa.binary()).to_pandas().str.len().to_numpy())])
        start = 0
        for a, b in zip(edges, edges[1:], strict=False):
            if b > stop:
                break
            if weight[b] - weight[start] >= most or b == stop:
                yield t.slice(start, b - start)
                start = b
        held, amount = t.slice(stop).to_batches(), int(weight[-1] - weight[stop])

    for b in batches:
        if b.num_rows:
            held.append(b)
            amount += b.column(size).nbytes if hasattr(b.column(size), "nbytes") else 0
            if amount >= 2 * most:
                yield from ready(False)
    if held:
        yield from ready(True)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of n units that some [start, end) covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def apply(scratch: Scratch, docs: DataFrame, marks: DataFrame, digest: Callable[[bytes, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """digest(text, starts, ends) of every document; marks: (row_key, s, e). Unmarked texts aren't shuffled if they can
    be told by a broadcast of checked size."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = batch.column("spans").to_pylist()
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), spans, strict=True):
                at = np.array([(x["s"], x["e"]) for x in own or ()], np.int64).reshape(-1, 2)
                out.append(digest(text or b"", at[:, 0], at[:, 1]))
            cols = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) if out else pa.array([], t) for c, t in zip(cols, _types(schema)[1:], strict=True))], names=names)

    per_doc = marks.groupBy("row_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    keys = scratch.write(marks.select("row_key").distinct(), "marked")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans")
    if few(keys):
        keys = F.broadcast(keys)
        plain = docs.join(keys, "row_key", "left_anti").select("doc_id", "text", none)
        marked = docs.join(keys, "row_key", "left_semi").join(per_doc, "row_key").select("doc_id", "text", "spans")
        return plain.mapInArrow(rows, schema).unionByName(marked.mapInArrow(rows, schema))
    return docs.join(per_doc, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(rows, schema)


def _types(schema: str) -> list[pa.DataType]:
    return [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]
