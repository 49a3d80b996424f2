"""Reads of a session whose tracker forgets: reuse distances, and the strategies that follow from them.

A tracker that remembers the `capacity` files read last knows a file again if fewer than `capacity` other files were read
since its last read: its reuse distance, the number of distinct files in between. Distances are counted block by block:
a session's reads are numbered and cut into blocks of BLOCK, and a distance is

    the reads of its own block before it whose file's last read lies before its own file's (first reads of a file count), plus
    where its last read lies in an earlier block: the reads behind that one in its block, and those of all blocks between, that are
    the last of their files before this block.

The counts in a block are dominance counts over sorted halves; those between are running sums over a grid of pairs of blocks.
No task holds more than a block or a row of the grid, however long a session is.

Reads with a null session or file are a session and a file of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.operators import scan, session
from impactgraph.operators.graph import cut_lineage

#: Reads of a block. A session of n reads has a grid of (n / BLOCK)^2 / 2 pairs: fewer than reads up to some 8 billion.
BLOCK = 1 << 16


def later_at_least(values: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each place, how many later values are at least `least` there; by halves, a sort and two searches for each size."""
    n, out = len(values), np.zeros(len(values), np.int64)
    rank = np.unique(np.concatenate([values, least]), return_inverse=True)[1]
    v, x, places = rank[:n], rank[n:], np.arange(n)
    span, size = int(rank.max(initial=0)) + 2, 1
    while size < n:
        pair, right = places // (2 * size), (places // size) % 2 == 1
        keys = np.sort(pair[right] * span + v[right])
        ask = ~right
        ends = np.searchsorted(keys, (pair[ask] + 1) * span, "left")
        out[ask] += ends - np.searchsorted(keys, pair[ask] * span + x[ask], "left")
        size *= 2
    return out


def _counts(size: int):
    """A block's own part: `head`, and `tail` of reads whose file is read again in a later block."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        before, after, block = rows["before"].to_numpy(np.int64), rows["after"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
        # Earlier reads with a smaller `before` are later ones with a greater negative, back to front.
        rows["head"] = later_at_least(-before[::-1], 1 - before[::-1])[::-1]
        never = np.iinfo(np.int64).max
        next_block = np.where(after < 0, -1, after // size)
        rows["tail"] = np.where(next_block > block, later_at_least(np.where(after < 0, never, after), np.where(after < 0, never, next_block * size)), 0)
        return rows[["session", "pos", "head", "tail"]]

    return count


def distances(reads: DataFrame, size: int = BLOCK) -> DataFrame:
    """reads (session, file, ts, seq, ...) with `pos` in the session and `distance`, null at a file's first read."""
    own = W.partitionBy("session", "file").orderBy("pos")
    placed = scan.prefix(reads, ["session"], ["ts", "seq"])
    placed = cut_lineage(placed.withColumns({"before": F.coalesce(F.lag("pos").over(own), F.lit(-1)), "after": F.coalesce(F.lead("pos").over(own), F.lit(-1)), "block": F.floor(F.col("pos") / size)}))
    kind = reads.schema["session"].dataType.simpleString()
    counted = placed.select("session", "pos", "before", "after", "block").groupBy("session", "block").applyInPandas(_counts(size), f"session {kind}, pos long, head long, tail long")
    # Reads by their block and that of the file's next read; a file that isn't read again lasts to the end.
    last = placed.groupBy("session").agg(F.max("block").alias("last"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ended = placed.join(last.withColumnRenamed("session", "s"), same("session", "s"))
    cells = ended.where("last > 1").groupBy("session", F.col("block").alias("c"), F.when(F.col("after") < 0, F.col("last")).otherwise(F.floor(F.col("after") / size)).alias("b"), "last").agg(F.count("*").alias("n"))
    steps = cells.select("session", "c", "last").distinct().where("c < last").select("session", "c", F.explode(F.sequence(F.col("c") + 1, F.col("last"))).alias("b"), F.lit(0).cast("long").alias("n"))
    grid = steps.unionByName(cells.where("b > c").select("session", "c", "b", "n")).groupBy("session", "c", "b").agg(F.sum("n").alias("n"))
    lasting = grid.withColumn("n", F.sum("n").over(W.partitionBy("session", "c").orderBy(F.desc("b"))))
    between = lasting.withColumn("n", F.sum("n").over(W.partitionBy("session", "b").orderBy(F.desc("c")))).select(F.col("session").alias("gs"), (F.col("c") - 1).alias("ga"), F.col("b").alias("gb"), F.col("n").alias("between"))
    own_part = counted.select(F.col("session").alias("hs"), F.col("pos").alias("hp"), "head")
    tail_part = counted.select(F.col("session").alias("ts_"), F.col("pos").alias("tp"), "tail")
    rows = placed.join(own_part, same("session", "hs") & (F.col("pos") == F.col("hp")))
    rows = rows.join(tail_part, same("session", "ts_") & (F.col("before") == F.col("tp")), "left").withColumn("from", F.floor(F.col("before") / size))
    rows = rows.join(between, same("session", "gs") & (F.col("from") == F.col("ga")) & (F.col("block") == F.col("gb")), "left")
    near = F.col("head") - (F.col("before") - F.col("block") * size + 1)
    far = F.col("head") + F.col("tail") + F.coalesce("between", F.lit(0))
    distance = F.when(F.col("before") >= 0, F.when(F.col("from") == F.col("block"), near).otherwise(far))
    return rows.select(*reads.columns, "pos", distance.alias("distance"))


def accesses(reads: DataFrame, capacity: int = session.CAPACITY, size: int = BLOCK) -> DataFrame:
    """What `session.accesses` tells, of a tracker of this capacity: `count`, reads of the file since it was last forgotten,
    `same` and `previous`, of the last such read; and `distance`."""
    placed = distances(reads, size)
    by = W.partitionBy("session", "file").orderBy("pos")
    forgotten = F.coalesce(F.col("distance") >= capacity, F.lit(True))
    life = placed.withColumn("life", F.sum(forgotten.cast("long")).over(by))
    own = W.partitionBy("session", "file", "life").orderBy("pos")
    return life.withColumns({
        "count": (F.row_number().over(own) - 1).cast("int"), "same": F.coalesce(F.lag("content_hash").over(own) == F.col("content_hash"), F.lit(False)), "previous": F.lag("tokens").over(own),
    }).drop("life")


def strategies(reads: DataFrame, window: int, capacity: int = session.CAPACITY) -> DataFrame:
    """The rows of `session.read_strategies`, of a tracker that remembers `capacity` files."""
    log = scan.prefix(accesses(reads, capacity), ["session"], ["ts", "seq"], {"sent": F.col("tokens")}, pos="__at").drop("__at")
    log = log.withColumn("since", F.col("sent") - F.coalesce("previous", F.lit(0))).drop("sent")
    sure = session.confidence(F.col("since"), F.lit(window))
    return log.withColumn("confidence", sure).withColumn("strategy", session.strategy(F.col("count"), F.col("same"), F.col("confidence"), F.lit(False)))
