"""Positions and running sums within groups of any size, in two levels: sums per block, offsets of blocks, then rows.

Rows are dealt by ranges of (keys, order), so that a group that holds most rows is many blocks and no task gets a whole
group. The order should be nearly unique: rows that tie in all of it share a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.operators.graph import cut_lineage


def prefix(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, pos: str = "pos", block: Column | None = None) -> DataFrame:
    """df with `pos`, from 0 in its group, and for each of sums the total of the group's rows before, 0 at first.

    Null keys are a group of their own; null values count as 0. `block`, a whole number that never falls along the order and
    that few enough rows of a group share, deals the rows where it is known; else ranges are drawn from a sample.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sums = {pos: F.lit(1).cast("long")} | {c: F.coalesce(v, F.lit(0)) for c, v in (sums or {}).items()}
    # The block of a row must be the same in both levels, so that one that Spark chooses is written.
    placed = df.withColumn("__block", block) if block is not None else cut_lineage(df.repartitionByRange(*keys, *order).withColumn("__block", F.spark_partition_id()))
    by = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    per = placed.groupBy(*keys, "__block").agg(*[F.sum(v).alias(f"__in_{c}") for c, v in sums.items()])
    offsets = per.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__block").alias("__own"), *[F.coalesce(F.sum(f"__in_{c}").over(by), F.lit(0)).alias(f"__off_{c}") for c in sums])
    met = F.col("__block") == F.col("__own")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    local = W.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = placed.join(offsets, met).withColumns({c: F.col(f"__off_{c}") + F.coalesce(F.sum(v).over(local), F.lit(0)) for c, v in sums.items()})
    return rows.select(*df.columns, *[c for c in sums])
