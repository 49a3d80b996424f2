"""An index of symbols and edges that follows changed files, with the component view kept up by counts.

Files, symbols and edges are stored by buckets of their file. A batch rewrites the buckets that its files lie in, under a
version of its own, and then names the current version of every bucket in a manifest; until that is written the batch hasn't
happened, and once it is, the same batch does nothing again. Readers of an older version aren't disturbed.

The induced edges are maintained, not built anew: what changed in symbols and edges becomes signed rows, and the change of the
join of edges with both their ends is the sum of three joins with those. A group whose weight comes to 0 goes.

Files of a batch replace all that was known of them; a deleted file takes its rows along. A file twice in a batch counts by its
greatest sha. Null files are left out. An empty batch changes nothing, and has a manifest too.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.operators import view
from impactgraph.operators.graph import cut_lineage
from impactgraph.functions import scalars as S

FILES = "file string, sha string"
SYMBOLS = "file string, id string, kind string, name string"
EDGES = "file string, src string, dst string, type string"
INDUCED = "src_comp string, dst_comp string, type string, weight long"
#: Buckets of files. A batch's work is that of the buckets it touches, and a manifest has a number for each.
BUCKETS = 64
#: Tasks that may write a bucket.
PARTS = 16
#: Changed symbols that may be broadcast: rows of an id, a component and a number.
FEW = 250_000


class GraphIndex:
    """Tables below a path that executors share. `apply` takes batches in rising order of their ids."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, depth: int = 0):
        self.spark, self.path, self.buckets, self.depth = spark, path.rstrip("/"), buckets, depth

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Batches that have a manifest."""
        at, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        names = [(x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(at)]
        return sorted(int(n) for n, p in names if n.isdigit() and fs.exists(self._fs(f"{p}/_SUCCESS")[0]))

    def manifest(self, batch: int | None = None) -> dict:
        """{"versions": {bucket: version}, "counts": {...}} of a batch, the last by default."""
        done = self.batches()
        if batch is None:
            if not done:
                return {"batch": None, "versions": {}, "counts": {}}
            batch = done[-1]
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{batch}").first()[0])

    def _read(self, table: str, schema: str, state: dict, only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/{v}/bucket={b}" for b, versions in state["versions"].items() if (only is None or int(b) in only) and (v := versions.get(table)) is not None]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def files(self) -> DataFrame:
        return self._read("files", FILES, self.manifest())

    def symbols(self) -> DataFrame:
        return self._read("symbols", SYMBOLS, self.manifest())

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES, self.manifest())

    def induced(self) -> DataFrame:
        """(src_comp, dst_comp, type, weight) between components, as `view.induced` counts them."""
        state = self.manifest()
        return self.spark.createDataFrame([], INDUCED) if state["batch"] is None else self.spark.read.schema(INDUCED).parquet(f"{self.path}/induced/{state['batch']}")

    def _ends(self, symbols: DataFrame) -> DataFrame:
        """(id, comp, w) of symbols that count in the view, with their number."""
        own = view.partitioned(symbols.withColumnRenamed("file", "file_path"), self.depth)
        return own.groupBy("id", "comp").agg(F.count("*").alias("w"))

    def _changed(self, old: DataFrame, new: DataFrame) -> DataFrame:
        keys = [c for c in new.columns if c != "w"]
        both = new.unionByName(old.withColumn("w", -F.col("w")))
        return cut_lineage(both.groupBy(*keys).agg(F.sum("w").alias("w")).where("w <> 0"))

    def _delta(self, edges_before: DataFrame, edge_change: DataFrame, before: DataFrame, change: DataFrame) -> DataFrame:
        """Signed rows of the view: changed edges at the new ends, old edges at a changed source and the new targets, and old
        edges at the old sources and a changed target."""
        after = before.unionByName(change).groupBy("id", "comp").agg(F.sum("w").alias("w")).where("w <> 0")
        end = lambda d, e: d.select(F.col("id").alias(e), F.col("comp").alias(f"{e}_comp"), F.col("w").alias(f"{e}_w"))
        small = F.broadcast(change) if change.count() <= FEW else change
        parts = [
            edge_change.join(end(after, "src"), "src").join(end(after, "dst"), "dst"), edges_before.join(end(small, "src"), "src").join(end(after, "dst"), "dst"),
            edges_before.join(end(small, "dst"), "dst").join(end(before, "src"), "src"),
        ]
        rows = [p.where("src_comp <> dst_comp").select("src_comp", "dst_comp", "type", (F.col("w") * F.col("src_w") * F.col("dst_w")).alias("weight")) for p in parts]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    def apply(self, batch: int, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict:
        """Counts of the batch: files seen, updated, skipped (of the same sha) and pruned, and symbols and edges written.

        files: file, sha, null where the file is deleted. symbols and edges: those of the batch's files; others are left out.
        """
        done = self.batches()
        if batch in done:
            return self.manifest(batch)["counts"]
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        state = self.manifest()
        number = F.pmod(F.xxhash64("file"), F.lit(self.buckets)).cast("int")
        given = files.where("file IS NOT NULL").groupBy("file").agg(F.max("sha").alias("sha"))
        touched = [x[0] for x in given.select(number).distinct().collect()]
        known = self._read("files", FILES, state, touched).select("file", F.col("sha").alias("was"))
        status = F.when(F.col("sha").isNull(), F.when(F.col("was").isNotNull(), "pruned").otherwise("unknown")).when(F.col("sha").eqNullSafe(F.col("was")), "skipped").otherwise("updated")
        judged = cut_lineage(given.join(known, "file", "left").withColumn("status", status))
        n = {x["status"]: x["count"] for x in judged.groupBy("status").count().collect()}
        moved = judged.where("status IN ('updated', 'pruned')").select("file", "sha")
        touched = [x[0] for x in moved.select(number).distinct().collect()]
        fresh = moved.where("sha IS NOT NULL")
        kinds = {"files": (FILES, fresh), "symbols": (SYMBOLS, symbols), "edges": (EDGES, edges)}
        versions = {b: dict(v) for b, v in state["versions"].items()}
        gone, come, written = {}, {}, {}
        for table, (schema, rows) in kinds.items():
            names = [c.split()[0] for c in schema.split(", ")]
            old = self._read(table, schema, state, touched)
            gone[table] = old.join(moved.select("file"), "file", "left_semi")
            given_rows = rows.select(*names).join(fresh.select("file"), "file", "left_semi")
            kept = old.join(moved.select("file"), "file", "left_anti").unionByName(given_rows).withColumn("bucket", number)
            # A bucket is up to PARTS tasks', as Spark sees fit; a run that failed before is written over.
            kept.repartition("bucket", F.pmod(F.xxhash64(*names), F.lit(PARTS))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{batch}")
            there = self.spark.read.schema(schema + ", bucket int").parquet(f"{self.path}/{table}/{batch}").groupBy("bucket").count().collect() if touched else []
            for b in touched:
                versions.setdefault(str(b), {})[table] = None
            for x in there:
                versions[str(x["bucket"])][table] = batch
            # What came is read from what was written, so that a batch's own plan runs once.
            come[table] = self._read(table, schema, {"versions": versions}, touched).join(fresh.select("file"), "file", "left_semi")
            written[table] = sum(x["count"] for x in there)
        edge_rows = lambda d: d.where(F.col("type").isin(*S.DEPENDENCY_KINDS)).groupBy("src", "dst", "type").agg(F.count("*").alias("w"))
        before = self._read("symbols", SYMBOLS, state)
        change = self._changed(self._ends(gone["symbols"]), self._ends(come["symbols"]))
        edge_change = self._changed(edge_rows(gone["edges"]), edge_rows(come["edges"]))
        delta = self._delta(edge_rows(self._read("edges", EDGES, state)), edge_change, self._ends(before), change)
        total = self.induced().unionByName(delta).groupBy("src_comp", "dst_comp", "type").agg(F.sum("weight").alias("weight")).where("weight <> 0")
        total.write.mode("overwrite").parquet(f"{self.path}/induced/{batch}")
        counts = {"files_seen": sum(v for k, v in n.items() if k in ("updated", "skipped")), "files_updated": n.get("updated", 0), "files_skipped": n.get("skipped", 0), "files_pruned": n.get("pruned", 0), "symbols_written": written["symbols"], "edges_written": written["edges"]}
        self.spark.createDataFrame([(json.dumps({"batch": batch, "versions": versions, "counts": counts}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{batch}")
        return counts

    def vacuum(self) -> None:
        """Delete versions that the last manifest doesn't name; no reader of an older one may run."""
        state = self.manifest()
        for table in ("files", "symbols", "edges"):
            used = {v[table] for v in state["versions"].values() if v.get(table) is not None}
            for old in self.batches():
                if old not in used:
                    at, fs = self._fs(f"{self.path}/{table}/{old}")
                    fs.delete(at, True)
        for old in self.batches()[:-1]:
            at, fs = self._fs(f"{self.path}/induced/{old}")
            fs.delete(at, True)

    def follow(self, changes: DataFrame, parse) -> object:
        """A stream writer of changed files (file, sha, ...): parse(batch rows) gives (files, symbols, edges) of a batch. A
        batch that the stream sends again, after a failure, does nothing."""
        return changes.writeStream.foreachBatch(lambda rows, batch: self.apply(batch, *parse(rows)))
