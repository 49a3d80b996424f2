"""Hard negatives by blocked dense products: the closest rows of an anchor's label, and rows of other labels in a window below.

Rows are quantised to integers and written once. Anchors are dealt into blocks of a checked size; one block at a time is
broadcast, and every task multiplies it with the candidates of its partition, batch by batch, in float64. That is exact
while the product of the greatest norms stays below 2^53; batches beyond are multiplied in Python integers. A task keeps the
best few rows of each anchor (a mergeable state), and Spark merges the tasks' states. The first pass finds the positives;
the second has their scores as windows and finds the best negatives inside each.

Work is anchors x rows, as the anchors are a stated query set; a pass of a block reads all rows. Nothing else grows faster
than the rows: a task's state is a few rows for each anchor of the block, and one block stands on the driver at a time.

Rows without an id, label or vector, and those with a null or non-finite component, take no part. Missing components of
a shorter vector are 0. Rows with one id are rows of their own; a row is never its own positive. Ties go by id, then by the
order of the written rows. A score beyond a long raises. Anchors without positives or negatives give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.llm.common import Scratch

#: Bytes of a broadcast block of anchors, and cells of one product, at most: 8 MB of float64.
BLOCK_BYTES, CELLS = 16 << 20, 1 << 20
#: Positives of an anchor, negatives of each, and the window of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Products of norms below this are exact in float64.
EXACT = float(1 << 53)

ROWS = "row long, id long, label long, v array<long>"
HITS = "anchor long, slot int, score long, row long, id long"


def quantised(rows: DataFrame, id_: str, vector: str, label: Column, scale: int, scratch: Scratch) -> DataFrame:
    """ROWS of those that take part, written once, so that `row` is the same in every pass."""
    x = F.col(vector)
    known = F.col(id_).isNotNull() & label.isNotNull() & x.isNotNull()
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floor = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    out = rows.where(known).where(whole).select(F.monotonically_increasing_id().alias("row"), F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), floor.alias("v"))
    return scratch.write(out, "rows")


class Block:
    """Rows as arrays: ids, labels, a matrix (of Python integers if float64 can't hold it), and the greatest norm."""

    def __init__(self, row: np.ndarray, id_: np.ndarray, label: np.ndarray, v: np.ndarray):
        self.row, self.id, self.label, self.v, self.f = row, id_, label, v, v.astype(np.float64)
        self.norm = float(np.sqrt((self.f * self.f).sum(axis=1).max())) if v.size else 0.0

    @classmethod
    def of(cls, t: pa.Table | pa.RecordBatch) -> Block:
        column = t.column("v")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = column.offsets.to_numpy()
        flat, sizes = column.values.to_numpy()[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.int64), np.diff(ends)
        width = int(sizes.max()) if len(sizes) else 0
        v = np.zeros((len(sizes), width), np.int64)
        v[np.arange(width) < sizes[:, None]] = flat
        return cls(*(t.column(c).to_numpy() for c in ("row", "id", "label")), v)

    def take(self, at: np.ndarray) -> Block:
        return Block(self.row[at], self.id[at], self.label[at], self.v[at])

    def scores(self, other: Block) -> np.ndarray:
        """Inner products with the rows of other, as exact integers in an array of float64 or of Python integers."""
        width = min(self.v.shape[1], other.v.shape[1])
        if self.norm * other.norm * (1 + 1e-9) < EXACT and max(self.norm, other.norm) < EXACT:
            return self.f[:, :width] @ other.f[:, :width].T
        exact = self.v[:, :width].astype(object) @ other.v[:, :width].astype(object).T
        if exact.size and (exact.max() >= 1 << 63 or exact.min() < -(1 << 63)):
            raise OverflowError("a score doesn't fit a long")
        return exact


class Best:
    """The first k of (score descending, id, row) for each key; mergeable, and bounded by k rows a key after shrink()."""

    def __init__(self, keys: int, k: int):
        self.k, self.parts, self.held, self.most = k, [], 0, max(1 << 16, 2 * keys * k)
        # What a new row must beat: the k-th score and id of a full key.
        self.least, self.last = np.full(keys, -(1 << 63), np.int64), np.full(keys, (1 << 63) - 1, np.int64)

    def beats(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray) -> np.ndarray:
        return (score > self.least[key]) | ((score == self.least[key]) & (id_ <= self.last[key]))

    def add(self, key: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        new = self.beats(key, score, id_)
        if new.any():
            self.parts.append((key[new], score[new], id_[new], row[new]))
            self.held += int(new.sum())
            if self.held > self.most:
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        key, score, id_, row = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((row, id_, ~score, key))  # ~ turns the order around and can't overflow
        key, score, id_, row = key[order], score[order], id_[order], row[order]
        start = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
        full = rank == self.k - 1
        self.least[key[full]], self.last[key[full]] = score[full], id_[full]
        keep = rank < self.k
        out = key[keep], score[keep], id_[keep], row[keep]
        self.parts, self.held = [out], int(keep.sum())
        return out


def _batches(batches: Iterator[pa.RecordBatch], anchors: int) -> Iterator[Block]:
    """Candidates in blocks whose product with the anchors has about CELLS cells at most."""
    most = max(1, CELLS // max(1, anchors))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield Block.of(batch.slice(at, most))


def _found(best: Best, anchors: Block, slots: int) -> Iterator[pa.RecordBatch]:
    key, score, id_, row = best.shrink()
    if len(key):
        columns = [pa.array(anchors.row[key // slots]), pa.array((key % slots).astype(np.int32)), pa.array(score), pa.array(row), pa.array(id_)]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "score", "row", "id"])


def _whole(scores: np.ndarray) -> np.ndarray:
    return scores.astype(np.int64)


def _positives(anchors: Block, k: int):
    """Products are made label by label, so that no product is made in vain."""
    of = {label: np.flatnonzero(anchors.label == label) for label in np.unique(anchors.label).tolist()}
    block_of = {label: anchors.take(own) for label, own in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.row), k)
        for block in _batches(batches, len(anchors.row)):
            for label, own in of.items():
                at = np.flatnonzero(block.label == label)
                if not len(at):
                    continue
                s = _whole(block_of[label].scores(block.take(at)))
                a, c = np.nonzero(s >= best.least[own][:, None])
                s, a, c = s[a, c], own[a], at[c]
                other = anchors.row[a] != block.row[c]
                best.add(a[other], s[other], block.id[c][other], block.row[c][other])
        yield from _found(best, anchors, 1)

    return run


def _negatives(anchors: Block, low: np.ndarray, high: np.ndarray, k: int):
    """low, high: (anchors, slots), the bounds of the scores of each positive; low > high where there is none."""
    slots = low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(low.size, k)
        for block in _batches(batches, len(anchors.row)):
            s = _whole(anchors.scores(block))
            floor = np.where(low > high, (1 << 63) - 1, np.maximum(low, best.least.reshape(low.shape)))
            a, c = np.nonzero((s >= floor.min(axis=1)[:, None]) & (s <= high.max(axis=1)[:, None]))
            other = anchors.label[a] != block.label[c]
            a, c = a[other], c[other]
            s = s[a, c]
            for slot in range(slots):
                inside = (s >= low[a, slot]) & (s <= high[a, slot])
                best.add(a[inside] * slots + slot, s[inside], block.id[c][inside], block.row[c][inside])
        yield from _found(best, anchors, slots)

    return run


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The first k of the tasks' states, with `rank` from 1; a key has k rows a task at most."""
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def _dealt(anchors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Anchors with a block number, written, and the number of blocks, none over BLOCK_BYTES."""
    facts = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, facts[1] or 0) + 64))
    blocks = max(1, -(-facts[0] // most))
    number = lambda: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    while (anchors.groupBy(number().alias("b")).count().agg(F.max("count")).first()[0] or 0) > most:
        blocks += -(-blocks // 4)
    return scratch.write(anchors.withColumn("block", number()), "anchors"), blocks


def _windows(anchors: Block, found: pa.Table, slots: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of integer scores: low% of the positive's <= score <= high% of it. 100 scores may be beyond a long."""
    lows, highs = np.ones((len(anchors.row), slots), np.int64), np.zeros((len(anchors.row), slots), np.int64)
    order = np.argsort(anchors.row)
    at = order[np.searchsorted(anchors.row, found.column("anchor").to_numpy(), sorter=order)], found.column("rank").to_numpy() - 1
    whole, rest = np.divmod(found.column("score").to_numpy(), 100)
    lows[at], highs[at] = low * whole - (-low * rest // 100), high * whole + high * rest // 100
    return lows, highs


def mine(
    rows: DataFrame, anchors: Column, id_: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_rank, positive_id, positive_score, rank, negative_id, negative_score).

    anchors is a condition on the column `id`; label an expression on rows, the column of that name by default. The
    window of a positive's negatives is low to high hundredths of its score; 0 <= low <= high <= 100.
    """
    if not 0 <= low <= high <= 100 or positives < 1 or negatives < 1:
        raise ValueError("0 <= low <= high <= 100, and one positive and negative at least")
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "negatives")
    all_ = quantised(rows, id_, vector, F.col("label") if label is None else label, scale, scratch)
    asked, blocks = _dealt(all_.where(anchors), scratch)
    out = None
    for number in range(blocks):
        table = asked.where(F.col("block") == number).drop("block").toArrow()
        if not table.num_rows:
            continue
        # One block of checked size on the driver, and again in each worker.
        block = spark.sparkContext.broadcast(Block.of(table))
        near = scratch.write(_merged(all_.mapInArrow(_run(_positives, block, positives), HITS), positives), f"positives{number}")
        windows = spark.sparkContext.broadcast(_windows(block.value, near.select("anchor", "rank", "score").toArrow(), positives, low, high))
        hard = scratch.write(_merged(all_.mapInArrow(_run(_negatives, block, windows, negatives), HITS), negatives), f"negatives{number}")
        near = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        own = asked.where(F.col("block") == number).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        part = hard.join(near, ["anchor", "slot"]).join(own, "anchor").select(
            "anchor_id", (F.col("slot") + 1).alias("positive_rank"), "positive_id", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        )
        scratch.write(part, f"out/block={number}")
        scratch.drop(f"positives{number}", f"negatives{number}")
        block.unpersist()
        windows.unpersist()
        out = part.schema
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_rank int, positive_id long, positive_score long, rank int, negative_id long, negative_score long")
    return spark.read.schema(out).parquet(f"{scratch.root}/out").select(*out.names)


def _run(make, block, *settings):
    """A task's function; the block is read from the broadcast once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = settings[0].value if make is _negatives else (settings[0],)
        yield from make(block.value, *first, *settings[1:])(batches)

    return run
