"""Jaccard join of documents' n-gram sets by grouped prefix filtering.

A set's shingles are ordered by a fixed order of all shingles: by how often their bucket occurs in the corpus, then by
hash. Two sets of Jaccard similarity T share a shingle within their first |x| - ceil(T |x|) + 1. Documents of one size and
one prefix are a group, which is one row in the join; groups that share a prefix shingle at positions that leave room for
the overlap needed are candidates; then they are expanded and their members verified.

A candidate pair passes two checks. Each set has a bitmap of the parities of its shingles by bucket, of one to two bits a
shingle; where two bitmaps differ the sets do, so that their difference is at least the number of such bits. That needs no
texts and leaves few pairs but the true ones. Those are compared in full, by the words themselves.

Components are wanted, not pairs. So each group is first compared with one other of each list, the one where the shingle stands
earliest; links found so far are merged, and the remaining join leaves out pairs within one component. No list is cut:
every pair is verified, lies within a component already, or fails a bound that is exact.

Words are runs of characters other than ASCII white space, A-Z lower-cased. A set has the distinct n-word shingles; a
text of fewer words has its whole sequence as one; a text without words, or null, has none and is linked with nothing.
A null doc_id is told as the component of its own row, null, unless a linked row has an id. Rows with equal ids are
documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm import hashing
from impactgraph.llm.common import Scratch, attach, few, keyed, numbered, texts_of
from impactgraph.llm.components import components

#: Words of a shingle; the similarity from which documents link, in hundredths.
N, PERCENT = 5, 80
#: Buckets of shingles that are counted over the whole corpus for the order, and of one row of counts.
BUCKETS, CHUNK = 1 << 21, 1 << 15
#: Shingles that a task gathers before it adds them to its counts.
HELD = 1 << 19

_TABLE = hashing.lower_ascii()


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    m = min(n, len(words))
    return hashing.distinct(hashing.sequences(words, m)) if m else np.zeros(0, np.uint64)


def sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    for t in texts:
        yield shingles(hashing.word_hashes(t.translate(_TABLE)), n)


def similar(a: bytes, b: bytes, n: int, percent: int) -> bool:
    """Whether two texts' sets are similar, by their words: shingles are tuples of word numbers, told apart exactly."""
    number: dict[bytes, int] = {}
    x, y = (np.fromiter((number.setdefault(w, len(number)) for w in t.translate(_TABLE).split()), np.int64) for t in (a, b))
    m = min(n, len(x))
    if not m or min(n, len(y)) != m:
        return False
    k, size = len(x) - m + 1, len(number)
    cols = [np.concatenate([x[j : j + k], y[j : len(y) - m + 1 + j]]) for j in range(m)]
    key, most = cols[0], size
    for c in cols[1:]:
        if most > (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
            most = len(key)
        key, most = key * size + c, most * size
    p, q = np.unique(key[:k]), np.unique(key[k:])
    both = len(np.intersect1d(p, q, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(p) + len(q) - both)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint32)


def _ranks(docs: DataFrame, n: int) -> np.ndarray:
    """For each bucket of shingles the logarithm of its number of documents' shingles, in eighths, as one byte.

    Every task sends its counts by bucket, whatever it read; their sums are one byte a bucket at the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(BUCKETS, np.uint32), [], 0

        def add() -> None:
            nonlocal held, size
            if held:
                own = np.sort(np.concatenate(held))
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
                total[own[first]] += np.diff(np.append(first, len(own))).astype(np.uint32)
                held, size = [], 0

        for batch in batches:
            for x in sets(texts_of(batch.column("text")), n):
                held.append(_bucket(x))
                size += len(x)
                if size >= HELD:
                    add()
        add()
        for at in range(0, BUCKETS, CHUNK):
            part = total[at : at + CHUNK]
            while part.any():  # counts beyond two bytes take further rows
                low = np.minimum(part, 0xFFFF)
                part = part - low
                yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int32()), pa.array([low.astype("<u2").tobytes()], pa.binary())], names=["chunk", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums.setdefault(c, np.zeros(CHUNK, np.uint64))[:] += np.frombuffer(counts, "<u2")
        for c, x in sums.items():
            rank = np.minimum(255, np.round(8 * np.log2(1 + x.astype(float)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["chunk", "rank"])

    schema = "chunk int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add_up, "chunk int, rank binary").collect()  # BUCKETS bytes
    out = np.zeros(BUCKETS, np.uint8)
    for r in rows:
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.rank, np.uint8)
    return out


def ordered(x: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """x in the order of all shingles: rare buckets first, then by hash."""
    return x[np.argsort(ranks[_bucket(x)], kind="stable")]


def bitmap(x: np.ndarray) -> bytes:
    """Parities of x's shingles by bucket, one to two buckets a shingle and 64 at least; a power of two of them."""
    bits = max(6, int(len(x)).bit_length())
    odd = np.bincount((x & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """A lower bound on how many shingles are in one of two sets alone. The larger bitmap is folded to the smaller's size."""
    x, y = (np.frombuffer(t, np.uint8) for t in ((a, b) if len(a) >= len(b) else (b, a)))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_GROUPED = "row_key long, doc_id long, n_shingles long, whole long, prefix_id long, prefix array<long>, bits binary"


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_ranks(docs, n))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        for batch in batches:
            size, whole, ids, prefixes, bits = [], [], [], [], []
            for x in sets(texts_of(batch.column("text")), n):
                m = len(x)
                head = ordered(x, ranks)[: m - -(-percent * m // 100) + 1].copy() if m else x
                size.append(m)
                whole.append(hashing.digest(x.tobytes()))
                ids.append(hashing.digest(head.tobytes()))
                prefixes.append(head.view(np.int64))
                bits.append(bitmap(x))
            if size:
                edge = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(prefixes)))
                numbers = [pa.array(c, pa.int64()) for c in (size, whole, ids)]
                yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), *numbers, flat, pa.array(bits, pa.binary())], names=["row_key", "doc_id", "n_shingles", "whole", "prefix_id", "prefix", "bits"])

    return docs.mapInArrow(rows, _GROUPED)


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, scratch: Scratch, name: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. First bitmaps meet, then the texts of what is left."""

    @F.pandas_udf("boolean")
    def near(na: pd.Series, nb: pd.Series, ba: pd.Series, bb: pd.Series) -> pd.Series:
        most = (100 - percent) * (na + nb)
        return pd.Series([(100 + percent) * differ(x, y) <= z for x, y, z in zip(ba, bb, most, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def same(ta: pd.Series, tb: pd.Series) -> pd.Series:
        return pd.Series([similar(x.encode(), y.encode(), n, percent) for x, y in zip(ta, tb, strict=True)], dtype=bool)

    one, two = (rows.select(F.col("row_key").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    met = attach(attach(pairs, "a", one, "b", scratch, f"{name}-1"), "b", two, "a", scratch, f"{name}-2", pairs)
    met = scratch.write(met.where(near("na", "nb", "ba", "bb")).select("a", "b"), f"{name}-near")
    names = met.select("a").union(met.select("b")).distinct()
    texts = docs.select("row_key", "text").join(F.broadcast(names) if few(met) else names, F.col("row_key") == F.col("a"), "left_semi")
    texts = scratch.write(texts, f"{name}-texts")
    one, two = (texts.select(F.col("row_key").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = attach(attach(met, "a", one, "b", scratch, f"{name}-3"), "b", two, "a", scratch, f"{name}-4", met)
    found = scratch.write(both.where(same("ta", "tb")).select("a", "b"), f"{name}-links")
    scratch.drop(f"{name}-texts", f"{name}-near")
    return found


def components_of(docs: DataFrame, scratch: Scratch, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(row_key, doc_id, n_shingles, component) of docs as `keyed` has them; a component is told by a row_key of its own."""
    rows = scratch.write(_prefixes(docs, n, percent), "prefixes")
    some = rows.where("n_shingles > 0")
    # Equal sets are one class; classes of one size and prefix one group. A group's least row stands for it.
    classes = some.groupBy("n_shingles", "prefix_id", "whole").agg(F.min("row_key").alias("class"))
    classes = scratch.write(classes, "classes")
    groups = classes.groupBy("n_shingles", "prefix_id").agg(F.min("class").alias("g"), F.count("*").alias("classes"))
    groups = scratch.write(groups, "groups")
    lists = rows.join(groups.select(F.col("g").alias("row_key")), "row_key", "left_semi")
    lists = lists.select(F.col("row_key").alias("g"), F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("at", "h"))
    shared = scratch.write(lists.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").select("h"), "shared-keys")
    lists = scratch.write(lists.join(shared, "h"), "shared")
    scratch.drop("shared-keys")
    room = f"{100 + percent} * least(n - at, m - to) >= {percent} * (n + m)"
    members = classes.join(groups, ["n_shingles", "prefix_id"])

    # First every group against the one of its list where the shingle stands earliest.
    first = lists.groupBy("h").agg(F.min(F.struct("at", "g", "n")).alias("x")).select("h", F.col("x.at").alias("to"), F.col("x.g").alias("o"), F.col("x.n").alias("m"))
    first = scratch.write(first, "first")
    star = lists.join(first, "h").where(f"g <> o AND {room}").select(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b")).distinct()
    # Within a group of several classes too, as they share all that the join looks at.
    inner = members.where("class <> g").select(F.col("g").alias("a"), F.col("class").alias("b"))
    stars = scratch.write(star.union(inner), "stars")
    scratch.drop("first")
    links = _verified(docs, rows, stars, scratch, "star", n, percent)
    met = scratch.write(components(scratch, links, "met"), "met")

    # Then all other pairs that aren't in one component yet; classes of one group stand side by side.
    known = F.coalesce("component", F.col("class")).alias("comp")
    sides = members.select("g", "class", "classes").join(met.withColumnRenamed("node", "class"), "class", "left").select("g", "class", known)
    spread = scratch.write(sides.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "spread")
    wide = lists.join(spread, "g")
    open_ = scratch.write(wide.groupBy("h").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).where("l < u").select("h"), "open-keys")
    wide = scratch.write(wide.join(open_, "h"), "open")
    scratch.drop("shared", "open-keys")
    other = wide.select("h", F.col("g").alias("o"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    rest = wide.join(other, "h").where(f"g < o AND {room} AND NOT (lo = hi AND olo = ohi AND lo = olo)").select("g", "o").distinct()
    left, right = (sides.select(F.col("g").alias(g), F.col("class").alias(c), F.col("comp").alias(k)) for g, c, k in (("g", "a", "ka"), ("o", "b", "kb")))
    pairs = rest.join(left, "g").join(right, "o").where("ka <> kb").select("a", "b")
    within = sides.join(spread.where("lo < hi"), "g").select("g", F.col("class").alias("a"), F.col("comp").alias("ka"))
    within = within.join(within.select("g", F.col("a").alias("b"), F.col("ka").alias("kb")), "g").where("a < b AND ka <> kb").select("a", "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(within).distinct()
    pairs = scratch.write(pairs.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    scratch.drop("open")
    more = _verified(docs, rows, pairs, scratch, "rest", n, percent)
    nodes = scratch.write(components(scratch, links.union(more), "all"), "nodes")

    class_of = rows.join(classes, ["n_shingles", "prefix_id", "whole"], "left").select("row_key", "doc_id", "n_shingles", F.coalesce("class", F.col("row_key")).alias("class"))
    placed = class_of.join(nodes.withColumnRenamed("node", "class"), "class", "left").select("row_key", "doc_id", "n_shingles", F.coalesce("component", F.col("class")).alias("component"))
    placed = scratch.write(placed, "placed")
    scratch.drop("prefixes")
    return placed


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the least id among the rows of its component."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    placed = components_of(keyed(docs, scratch), scratch, n, percent)
    # Written first, so that the join can split a component that holds a third of all rows.
    ids = scratch.write(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")
    return placed.join(ids, "component").select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, nulls last; of equal ids, any one.

    Columns and rows of other components stay as they are, whatever ids they have.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    rows = numbered(docs, scratch)
    placed = components_of(rows.select("row_key", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text")), scratch, n, percent)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row_key"))["row_key"].alias("first")
    first = scratch.write(placed.groupBy("component").agg(first), "ids")
    gone = scratch.write(placed.join(first, "component").where("row_key <> first").select("row_key"), "gone")
    return rows.join(F.broadcast(gone) if few(gone) else gone, "row_key", "left_anti").select("doc.*")
