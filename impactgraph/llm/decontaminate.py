"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

Words are maximal runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A benchmark item gives its windows
of `n` consecutive words; an item of fewer words, but not none, is one window. A document word inside an occurrence of
a window is hit.

Null texts have no words. Items without words are never found. Repeated items count once, and so do all items without an id
together, which the digest of ids leaves out; repeated documents are judged one by one. An empty benchmark hits nothing, an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm import hashing
from impactgraph.llm.common import Scratch, keyed, numbered, slices, texts_of

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

#: Words of a window; the share of hit words from which a document counts as contaminated is 1 / SHARE.
WINDOW, SHARE = 13, 20

#: Letters of ASCII to lower case; every other ASCII character but digits to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Bytes of hit documents' rows that may be broadcast.
HITS_BYTES = 16 << 20
#: Benchmark text of a part; a larger benchmark is matched part by part, each in a pass of its own. What is built of a part
#: and broadcast is some 4 bytes for each of its text. An item's text is in one part, however long.
PART_BYTES = 8 << 20


@dataclass
class Grams:
    """Test n-grams of a part: its words, and by length the sorted hashes of the n-grams and the words that they start at."""

    items: list[str | None]
    joined: bytes
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    def text(self, at: int, k: int) -> bytes:
        return self.joined[self.start[at] : self.end[at + k - 1]]


def grams(benchmark: Iterable[tuple[str | None, str]], n: int = WINDOW) -> Grams:
    """benchmark: (item id, text)."""
    items: dict[str | None, int] = {}
    texts, of = [], []
    for item, text in benchmark:
        words = (text or "").encode().translate(TABLE).split()
        if words:
            texts.append(b" ".join(words))
            of.append(items.setdefault(None if item is None else str(item), len(items)))
    w = hashing.Words(texts or [b""])
    size = np.diff(w.first)
    owner = np.repeat(np.array(of, np.int32), size) if texts else np.zeros(0, np.int32)
    g = Grams(list(items), w.joined, w.start.astype(np.int32), w.end.astype(np.int32), owner, {})
    p, places = hashing.prefix(w.hash), np.arange(len(w))
    left = np.repeat(w.first[1:], size) - places  # words to the end of the row
    for k in sorted({min(n, int(m)) for m in size if m}):
        at = places[left >= k] if k == n else w.first[:-1][size == k]
        h = hashing.windows(p, k)[at]
        order = np.lexsort((at, owner[at], h))
        h, at = h[order], at[order]
        # An item's copies of one n-gram are one; equal hashes alone don't make a copy.
        keep = np.ones(len(h), bool)
        for i in np.flatnonzero((h[1:] == h[:-1]) & (owner[at[1:]] == owner[at[:-1]])).tolist():
            keep[i + 1] = g.text(at[i], k) != g.text(at[i + 1], k)
        g.by_length[k] = h[keep], at[keep].astype(np.int32)
    return g


def scan(texts: list[bytes], g: Grams) -> list[tuple[int, np.ndarray, list[int]]]:
    """For each text: how many words, which are hit (a mask), and the items found."""
    w = hashing.Words(texts, TABLE)
    hit = np.zeros(len(w) + 1, np.int32)
    found: list[set[int]] = [set() for _ in texts]
    p = hashing.prefix(w.hash)
    for k, (keys, places) in g.by_length.items():
        h = hashing.windows(p, k)
        seen = np.zeros(1 << 16, bool)
        seen[keys >> np.uint64(48)] = True
        at = np.flatnonzero(seen[h >> np.uint64(48)])
        at = at[w.of[at] == w.of[at + k - 1]]
        low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
        some = low < high
        for i, a, b in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            words = w.text(i, i + k)
            same = {int(g.owner[x]) for x in places[a:b].tolist() if g.text(x, k) == words}
            if same:
                hit[i] += 1
                hit[i + k] -= 1
                found[w.of[i]].update(same)
    mask = np.cumsum(hit[:-1]) > 0
    return [(int(b - a), mask[a:b], sorted(f)) for a, b, f in zip(w.first, w.first[1:], found, strict=False)]


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def _parts(benchmark: DataFrame, item_id: str, n: int, scratch: Scratch) -> Iterator[Grams]:
    """The benchmark as parts of at most PART_BYTES of text each, built in a task each and fetched one at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    rows = scratch.write(rows.withColumn("at", F.xxhash64("i", "t")), "benchmark")
    size, most = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.max(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-size * 4 // (3 * PART_BYTES)))
    number = lambda: F.pmod("at", F.lit(parts)).cast("int").alias("part")
    while (rows.groupBy(number()).agg(F.sum(F.octet_length("t")).alias("b")).agg(F.max("b")).first()[0] or 0) > max(PART_BYTES, most):
        parts += -(-parts // 4)

    def build(table: pa.Table) -> pa.Table:
        g = grams(zip(table.column("i").to_pylist(), table.column("t").to_pylist(), strict=True), n)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "grams": pa.array([pickle.dumps(g)], pa.binary())})

    built = scratch.write(rows.select(number(), "i", "t").groupBy("part").applyInArrow(build, "part int, grams binary"), "parts")
    for part in range(parts):
        one = built.where(F.col("part") == part).toArrow()
        if one.num_rows:
            yield pickle.loads(one.column("grams")[0].as_py())


def _digest(items: Iterable[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(x for x in items if x is not None)).encode()).hexdigest()


_HITS = "row_key long, spans array<struct<s:int,e:int>>, items array<string>, unnamed boolean"


def _hits(scratch: Scratch, docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(row_key, spans of hit words, items found, whether one without an id is): a row for each document and part that meet.

    docs: (row_key, text). Each part is broadcast, matched in one pass that shuffles nothing, and given up before the next.
    """
    found = docs.sparkSession.createDataFrame([], _HITS)
    for at, part in enumerate(_parts(benchmark, "item_id", n, scratch)):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            g, types = sent.value, (pa.int64(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.string()), pa.bool_())
            for batch in batches:
                texts, keys = texts_of(batch.column("text")), batch.column("row_key").to_pylist()
                out = []
                for a, b in slices(texts):
                    for i, (_, mask, items) in enumerate(scan(texts[a:b], g)):
                        if items:
                            names = [g.items[x] for x in items]
                            out.append((keys[a + i], [{"s": s, "e": e} for s, e in _runs(mask)], [x for x in names if x is not None], None in names))
                cols = zip(*out, strict=True) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row_key", "spans", "items", "unnamed"])

        table = scratch.write(docs.mapInArrow(rows, _HITS), f"hits{at}")
        sent.unpersist()
        found = found.unionByName(table)
    return found


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """docs (row_key and others, with text) with `spans`, `items` and `unnamed` of all parts; null where nothing is hit."""
    hits = _hits(scratch, docs.select("row_key", "text"), benchmark, n)
    per = hits.groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.bool_or("unnamed").alias("unnamed"))
    per = scratch.write(per, "per-document")
    # A row has as many spans and items as its document; what they take is summed before they are broadcast.
    size = per.agg(F.coalesce(F.sum(64 + 24 * F.size("spans") + F.octet_length(F.array_join("items", "")) + 24 * F.size("items")), F.lit(0))).first()[0]
    return docs.join(F.broadcast(per) if size <= HITS_BYTES else per, "row_key", "left")


def _mask(n_words: int, spans: list[dict] | np.ndarray | None) -> np.ndarray:
    step = np.zeros(n_words + 1, np.int32)
    for x in () if spans is None else spans:
        step[x["s"]] += 1
        step[x["e"]] -= 1
    return np.cumsum(step[:-1]) > 0


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document, as SCHEMA has it."""
    scratch = Scratch(docs.sparkSession, "decontaminate")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for batch in batches:
            out = []
            for text, spans, items, unnamed in zip(texts_of(batch.column("text")), *(batch.column(c).to_pylist() for c in ("spans", "items", "unnamed")), strict=True):
                n_words = len(text.translate(TABLE).split())
                n_hit = int(_mask(n_words, spans).sum()) if spans else 0
                out.append((n_words, n_hit, len(items or ()) + bool(unnamed), _digest(items or ()), contaminated(n_words, n_hit)))
            cols = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _judged(keyed(docs, scratch), benchmark, n, scratch).select("doc_id", "text", "spans", "items", "unnamed").mapInArrow(rows, SCHEMA)


def remove(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, spans: bool = False) -> DataFrame:
    """The documents without the contaminated ones, or (spans) with the hit words cut out of their texts.

    Columns, their order and all other rows stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = numbered(docs, scratch)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series, found: pd.Series) -> pd.Series:
        size = [len((t or "").encode().translate(TABLE).split()) for t in text]
        return pd.Series([not contaminated(k, int(_mask(k, f).sum())) for k, f in zip(size, found, strict=True)], dtype=bool)

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, f in zip(text, found, strict=True):
            b = t.encode()
            w = hashing.Words([b], TABLE)
            drop = np.zeros(len(b), bool)
            for s, e in _runs(_mask(len(w), f)):
                drop[w.start[s] : w.end[e - 1]] = True
            out.append(np.frombuffer(b, np.uint8)[~drop].tobytes().decode())
        return pd.Series(out, index=text.index, dtype=object)

    got = _judged(rows.select("row_key", "doc", F.col("doc.text").alias("text")), benchmark, n, scratch)
    hit = F.col("spans").isNotNull()
    if not spans:
        keep = got.where(~hit).select("doc").unionByName(got.where(hit).where(clean("text", "spans")).select("doc"))
        return keep.select("doc.*")
    same, less = got.where(~hit).select("doc"), got.where(hit).select("doc", cut("text", "spans").alias("text"))
    return same.unionByName(less.select(F.col("doc").withField("text", F.col("text")).alias("doc"))).select("doc.*")


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).tolist()
    return zip(edge[::2], edge[1::2], strict=True)
