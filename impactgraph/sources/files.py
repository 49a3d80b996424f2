"""Sources and sinks besides the derived tables: file trees, diffs, histories, merge records, settings, ledgers."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest file that is read, and the bytes at its head in which a NUL means binary.
MAX_FILE_BYTES, BINARY_HEAD = 2 << 20, 1024
# Folders that are never walked.
EXCLUDED = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "target")


def tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED, ignored: tuple[str, ...] = ()) -> DataFrame:
    """file, content of the text files below a root: no excluded folder, no ignored plain name, nothing large or binary.

    Length is a column of the listing, so that large files aren't opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.col("length") <= MAX_FILE_BYTES)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.regexp_replace("path", "^file:/*", "/")
    rel = F.substring(path, F.length(base) + 2, F.length(path))
    parts = F.split(rel, "/")
    files = files.withColumn("file", rel).where(~F.arrays_overlap(parts, F.array(*map(F.lit, (*exclude, *ignored)))))
    head = F.hex(F.substring("content", 1, BINARY_HEAD))
    binary = F.regexp_like(head, F.lit("^(?:..)*?00"))
    return files.where(~binary).select("file", F.decode("content", "UTF-8").alias("content"))


def inside(root: str, path: str) -> str | None:
    """A path relative to its root, or None if it leaves the root."""
    out: list[str] = []
    rel = path[len(root) :].lstrip("/") if path.startswith(root.rstrip("/") + "/") else path
    if rel.startswith("/"):
        return None
    for part in PurePosixPath(rel).parts:
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out)


_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """(file, line, text, deleted) of a unified diff: each hunk header with the file it changes, by its old path where the
    diff deletes it. Lines of a hunk are counted, so that no body line is read as a header."""
    old, file, rows, left = "", "", [], [0, 0]
    for i, line in enumerate(text.split("\n")):
        m = _HUNK.match(line)  # no body line begins like that, as each has a mark in front
        if max(left) > 0 and not m:  # "\\ No newline" is on neither side
            left[0] -= line[:1] in ("-", " ", "")
            left[1] -= line[:1] in ("+", " ", "")
        elif line.startswith("--- "):
            old = line[4:].removeprefix("a/").strip()
        elif line.startswith("+++ "):
            file = line[4:].removeprefix("b/").strip()
        elif m:
            gone = file == "/dev/null"
            rows.append((old if gone else file, i, line, gone))
            left = [int(n if n is not None else 1) for n in m.groups()]
    return spark.createDataFrame(rows, "file string, line int, text string, deleted boolean")


def touches(spark: SparkSession, log: str) -> DataFrame:
    """(ts, file) from a history: lines `@<unix seconds>`, each followed by the files of that commit."""
    at, rows = None, []
    for line in map(str.strip, log.split("\n")):
        if line.startswith("@") and line[1:].isdigit():
            at = int(line[1:])
        elif line and at is not None:
            rows.append((at, line))
    return spark.createDataFrame(rows, "s long, file string").select(F.timestamp_seconds("s").alias("ts"), "file")


MERGES = T.ArrayType(T.StructType([T.StructField("file", T.StringType()), T.StructField("order", T.IntegerType()), *[T.StructField(k, T.ArrayType(T.StringType())) for k in ("changed", "renamed", "added", "removed")]]))


def merge_records(records: DataFrame) -> DataFrame:
    """(file, change, name) of JSON merge records (column `json`), changes in the order changed, renamed, added, removed."""
    rows = records.select(F.inline(F.from_json("json", MERGES)))
    kinds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("change"), F.coalesce(F.col(k), F.array()).alias("names")) for i, k in enumerate(("changed", "renamed", "added", "removed"))])
    each = rows.select("file", F.explode(kinds).alias("k")).select("file", "k.i", "k.change", F.explode("k.names").alias("name"))
    return each.orderBy("file", "i", "name").drop("i")


@dataclass
class Settings:
    model: str = ""
    profile: str = "default"
    budget: int = 8000
    arch_deny: list[str] = field(default_factory=list)
    other: dict[str, str] = field(default_factory=dict)


def settings(text: str) -> Settings:
    """`key: value` lines; # begins a comment; arch_deny may repeat."""
    out = Settings()
    for line in text.split("\n"):
        key, colon, value = line.split(" #", 1)[0].partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        if not colon or not key or key.startswith("#"):
            continue
        if key == "arch_deny":
            out.arch_deny.append(value)
        elif key == "budget":
            out.budget = int(value) if value.isdigit() else out.budget
        elif key in ("model", "profile"):
            setattr(out, key, value)
        else:
            out.other[key] = value
    return out


def save(table: DataFrame, path: str, kind: str = "parquet") -> None:
    """A snapshot of a ledger or of learned weights: a folder of its own below path. Readers take the latest one that has
    its _SUCCESS file, so that one that is cut off replaces nothing; older ones are deleted then."""
    at, fs = _hadoop(table.sparkSession, path)
    before = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    table.write.format(kind).save(f"{path}/{time.time_ns():020d}")
    for p in before:
        fs.delete(p, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A saved snapshot; without one, an empty table of the schema."""
    at, fs = _hadoop(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    done = [n for n in names if fs.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[0])]
    return spark.read.schema(schema).format(kind).load(f"{path}/{done[-1]}") if done else spark.createDataFrame([], schema)


def indexed(symbols: DataFrame) -> bool:
    """Whether there is anything to ask about; callers index once where there isn't."""
    return not symbols.limit(1).isEmpty()
