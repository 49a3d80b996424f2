"""Queries on an index that follows changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.operators.incremental import GraphIndex
from impactgraph.plans.catalog import query
from impactgraph.sources import adapters as A
from impactgraph.sources import scratch


def _batches(spark: SparkSession, sf: str) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """All files; then files without some symbols and with other edges; then all files of a region deleted, and one back."""
    s = scratch.stored(A.symbols(spark, sf).select(F.col("file_path").alias("file"), "id", "kind", "name"), "symbols")
    # The edges of all batches are one join, which is run once.
    e = scratch.stored(A.edges(spark, sf).join(s.select("file", F.col("id").alias("src")), "src").select("file", "src", "dst", "type"), "edges")
    key = F.substring_index("id", ":", -1).cast("long")
    files = s.select("file").distinct()
    less, other = s.where(key % 5 != 0), e.withColumn("type", F.when(F.col("type") == "imports", "calls").otherwise(F.col("type")))
    asia = files.where(F.startswith("file", F.lit("ASIA/")))
    back = asia.where(F.contains("file", F.lit("/customer")))
    sha = lambda d, x: d.select("file", F.lit(x).alias("sha"))
    suppliers = files.where(F.contains("file", F.lit("/supplier")))
    return [(sha(files, "1"), s, e), (sha(suppliers, "2").union(sha(files.join(suppliers, "file", "left_anti"), "1")), less, other), (sha(asia, None), less.limit(0), e.limit(0)), (sha(back, "3"), s, other)]


@query(A.with_tables("symbols", "edges") + """, s AS (SELECT *, CASE WHEN file_path LIKE '%/supplier%' THEN NOT (region = 'ASIA') AND CAST(substr(id, 3) AS BIGINT) % 5 <> 0 ELSE TRUE END AS known FROM symbols),
    own AS (SELECT * FROM s WHERE known AND NOT test),
    e AS (SELECT edges.src, dst, CASE WHEN s.region = 'ASIA' AND type = 'imports' THEN 'calls' ELSE type END AS type FROM edges JOIN symbols s ON s.id = edges.src)
    SELECT f.comp AS src_comp, t.comp AS dst_comp, type, count(*) AS weight FROM e JOIN own f ON e.src = f.id JOIN own t ON e.dst = t.id WHERE f.comp <> t.comp GROUP BY ALL""")
def maintained_edges(spark, sf):
    """The component view after four batches, each applied twice."""
    index = GraphIndex(spark, scratch.folder(spark, "graph-index"), 16)
    for number, batch in enumerate(_batches(spark, sf)):
        counts = index.apply(number, *batch)
        if index.apply(number, *batch) != counts:
            raise RuntimeError("a batch happened twice")
    return index.induced()
