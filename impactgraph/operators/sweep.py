"""Rows that changed ranges touch, by a sweep: starts, ends and questions of a file in one order, and running counts.

A row's lines lo to hi meet a range if more ranges have begun by hi than have ended before lo. Both counts are prefix sums in
two levels, by blocks of LINES lines, so that one file with all rows and ranges is many tasks, and work grows with their number, not their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.operators import scan

#: Lines of a block of a file.
LINES = 1 << 14


def touched(rows: DataFrame, lo: str, hi: str, changed: DataFrame, file: str = "file") -> DataFrame:
    """rows with `touched`: whether a range of changed (file, start, end) has a line in lo to hi of the row's file.

    Ranges without a file or with their end before their start touch nothing; rows without a file or lines are untouched.
    """
    row = F.struct(*rows.columns).alias("row")
    asked = rows.select(F.monotonically_increasing_id().alias("id"), F.col(file).alias("file"), F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), row)
    each = F.inline(F.array(F.struct((2 * F.col("lo")).alias("place"), F.lit(None).cast(asked.schema["row"].dataType).alias("row")), F.struct((2 * F.col("hi")).alias("place"), F.col("row"))))
    known = F.col("file").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull()
    asks = asked.where(known).select("id", "file", each).select("id", "file", "place", "row", F.lit(1).alias("kind"), F.lit(0).alias("starts"), F.lit(0).alias("ends"))
    good = changed.where("file IS NOT NULL AND start <= end")
    mark = lambda place, start: good.select(F.lit(None).cast("long").alias("id"), "file", place.cast("long").alias("place"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.lit(0).alias("kind"), F.lit(start).alias("starts"), F.lit(1 - start).alias("ends"))
    marks = mark(2 * F.col("start"), 1).unionByName(mark(2 * F.col("end") + 1, 0))
    # Many starts may tie, and a question never ties with one; ids make the order nearly unique.
    counted = scan.prefix(asks.unionByName(marks), ["file"], ["place", "kind", "id"], {"begun": F.col("starts"), "ended": F.col("ends")}, block=F.floor(F.col("place") / (2 * LINES))).where("kind = 1")
    # begun counts at hi, where the row is; ended at lo.
    met = counted.groupBy("id").agg(F.first("row", True).alias("row"), F.max(F.when(F.col("row").isNotNull(), F.col("begun"))).alias("begun"), F.max(F.when(F.col("row").isNull(), F.col("ended"))).alias("ended"))
    out = met.select("row.*", (F.col("begun") > F.col("ended")).alias("touched"))
    return out.unionByName(asked.where(~known).select("row.*", F.lit(False).alias("touched")))
