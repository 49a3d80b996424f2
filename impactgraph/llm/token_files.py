"""Token ids of documents in a block format of Simple-8b words.

A table of ids is a Parquet folder; each row holds one document of the sequence: its ids packed by Simple-8b as
little-endian 64-bit words, the word offset of each block of 1,024 ids, the number of ids, and the number of ids that
come before it in its shard. Shards are ranges of doc_id in ascending order; shard_base has the ids before each shard.
Parquet carries the blocks because it is written and committed by Spark on any store, once per task.

Documents stand in ascending doc_id order, null ids first; rows with the same id in the order of their texts' hash.
Null text is empty: such a document has its end id alone. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactgraph.llm import simple8b
from impactgraph.llm.common import Scratch, bound_batches, slices, texts_of
from impactgraph.llm.tokens import WordIds

FILE_SCHEMA = "shard int, doc_id long, before long, n_tokens long, blocks array<int>, words binary"

#: Bytes of text that a shard should hold.
SHARD_BYTES = 64 << 20


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shards: int | None = None) -> None:
    """Encode every whole text, append end_id to each, and write the ids to `path` in the order of doc_id.

    Texts are dealt by ranges of doc_id first and encoded after, so that the costly encoding runs once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(2 * spark.sparkContext.defaultParallelism, size // SHARD_BYTES + 1)
    tie = F.xxhash64("text")
    ordered = docs.repartitionByRange(shards, "doc_id", tie).sortWithinPartitions("doc_id", tie).withColumn("shard", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, end = WordIds(tokenizer_path), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in slices(texts):
                coded = encoder.encode(texts[a:b])
                size = np.fromiter(map(len, coded), np.int64, b - a) // 4 + 1
                flat = np.frombuffer(end.join([*coded, b""]), "<u4")
                words, blocks, (word_edge, block_edge) = simple8b.pack_many(flat, size)
                blocks = blocks - np.repeat(word_edge[:-1], np.diff(block_edge))
                at = before + np.cumsum(size) - size
                before += int(size.sum())
                raw = words.astype("<u8").tobytes()
                lists = pa.ListArray.from_arrays(pa.array(block_edge.astype(np.int32)), pa.array(blocks.astype(np.int32)))
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((word_edge * 8).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(at), pa.array(size), lists, binary], names=["shard", "doc_id", "before", "n_tokens", "blocks", "words"])

    ordered.select("shard", "doc_id", "text").mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """The rows of a written table, with `start`: the ids of all documents before each."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # one number for each shard
    base, total = [], 0
    for shard, n in sorted(map(tuple, sizes)):
        base.append((shard, total))
        total += n
    bases = spark.createDataFrame(base, "shard int, base long")
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def ids(blocks: np.ndarray, words: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a document, or (first, last) of its blocks from first up to last: only their words are decoded."""
    blocks, flat = np.asarray(blocks, np.int64), np.frombuffer(words, "<u8")
    last = len(blocks) if last is None else min(last, len(blocks))
    if first >= last:
        return np.zeros(0, "<u4")
    sizes = np.minimum(simple8b.BLOCK, n - np.arange(first, last) * simple8b.BLOCK)
    end = blocks[last] if last < len(blocks) else len(flat)
    return simple8b.unpack(flat[blocks[first] : end], int(sizes.sum()), blocks[first:last] - blocks[first], sizes).astype("<u4")


def digests(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the ids that the files hold.

    The blocks of a slice of documents are decoded side by side, each from its offset.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words").to_pylist()
            n = np.asarray(batch.column("n_tokens"))
            blocks = batch.column("blocks")
            crc = [0] * len(words)
            for a, b in slices(words):
                own = blocks.slice(a, b - a)
                per_doc = np.diff(np.asarray(own.offsets))
                before = np.concatenate([[0], np.cumsum([len(w) // 8 for w in words[a:b]])])
                starts = np.asarray(own.flatten()) + np.repeat(before[:-1], per_doc)
                number = np.arange(len(starts)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                sizes = np.minimum(simple8b.BLOCK, np.repeat(n[a:b], per_doc) - number * simple8b.BLOCK)
                flat = simple8b.unpack(np.frombuffer(b"".join(words[a:b]), "<u8"), int(n[a:b].sum()), starts, sizes).astype("<u4")
                edge = np.concatenate([[0], np.cumsum(n[a:b])])
                for i in range(a, b):
                    crc[i] = zlib.crc32(flat[edge[i - a] : edge[i - a + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("doc_id", "start", "n_tokens", "blocks", "words").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_check(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the ids of docs below the shared folder, read them back, and report on every document."""
    scratch = Scratch(docs.sparkSession, "token-files")
    path = f"{scratch.root}/ids"
    write(docs, path, tokenizer_path, end_id)
    scratch.release()
    return digests(read(docs.sparkSession, path))
