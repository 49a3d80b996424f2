"""Helpers that the corpus operators share: scratch tables, row keys, batch slicing."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at a time; bounds its numpy temporaries.
SLICE_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else a temporary one (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="impactgraph-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows and bytes of an Arrow batch at most. A batch stands in the JVM and in its Python worker at the same time.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower this session's limits on Arrow batches, if they are higher, so that a worker's memory has a bound."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Seconds between two collections of garbage.
RELEASE = 3.0


class Scratch:
    """Intermediate tables of one operator call, written as Parquet below the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks that it ran, not the operator. Results are lazy and
    may read these tables, so that they stay until close() or the end of the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.released = time.monotonic()
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def close(self) -> None:
        """Delete all tables; nothing that reads them may run after this."""
        path, fs = self._at(self.root)
        fs.delete(path, True)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner drop shuffle files of finished jobs now, not at the next chance collection; every RELEASE
        seconds at most, as short jobs leave little."""
        if time.monotonic() - self.released >= RELEASE:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            self.released = time.monotonic()

    def drop(self, *tables: str) -> None:
        for table in tables:
            path, fs = self._at(f"{self.root}/{table}")
            fs.delete(path, True)


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_key, doc_id, text) with a unique, non-null row_key and null text read as empty."""
    rows = numbered(docs, scratch)
    return rows.select("row_key", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce("doc.text", F.lit("")).alias("text"))


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_key, doc): all columns of docs as one struct, so that no name clashes with another.

    doc_id itself is the key when it is unique and never null; otherwise rows are numbered once and written, so that
    every later pass sees the same numbers.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("row_key"), F.struct("*").alias("doc"))
    return scratch.write(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct("*").alias("doc")), "numbered")


#: Rows of two or three numbers that may be broadcast: some 16 MB.
FEW = 250_000


def few(df: DataFrame, rows: int = FEW) -> bool:
    """Whether df has at most this many rows; the check in front of every broadcast of computed data.

    Each task sends one count. df should be a written table, so that nothing is computed twice.
    """
    return df.count() <= rows


#: Rows that may share one key of a join; a key with more is split.
SHARE = 4096


def attach(rows: DataFrame, key: str, table: DataFrame, spread: str, scratch: Scratch, name: str, narrow: DataFrame | None = None) -> DataFrame:
    """rows joined to table (unique by `key`), with a key of more than SHARE rows split by a hash of `spread`.

    The table's row of such a key is repeated once for each part, so that no task gets more than about SHARE rows of it.
    `narrow` is the written table of numbers that rows come from, if they carry more; rows that hold texts or bitmaps are
    never broadcast, and only numbers are counted.
    """
    numbers = rows if narrow is None else narrow
    small = few(numbers)
    if small and narrow is None:
        return table.join(F.broadcast(rows), key)
    hot = numbers.groupBy(key).agg(F.count("*").alias("__n")).where(f"__n > {SHARE}").select(key, F.ceil(F.col("__n") / SHARE).cast("int").alias("__parts"))
    hot = scratch.write(hot, f"{name}-hot")
    if few(hot):
        hot = F.broadcast(hot)
    if small:
        table = table.join(F.broadcast(numbers.select(key).distinct()), key, "left_semi")
    part = F.coalesce(F.pmod(F.xxhash64(spread), "__parts"), F.lit(0)).cast("int").alias("__part")
    left = rows.join(hot, key, "left").select(*rows.columns, part)
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0)))).alias("__part")
    right = table.join(hot, key, "left").select(*table.columns, parts)
    return left.join(right.hint("merge"), [key, "__part"]).drop("__part")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text has a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
