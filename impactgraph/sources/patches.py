"""Unified diffs as tables, and the text before a change from the text after it.

A diff is rows (change, n, text): a line of a change's diff and its place. Which lines belong to a hunk follows from counts that
run through the change in two levels, so that no diff is read by one task, and no line of a hunk is taken for a
header, whatever it looks like. Diffs without context and with it are read alike.

Reverse patching needs no copy of the old text: lines outside hunks move by the running sum of what the hunks before them took
and gave, and the lines of hunks come from the diff.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactgraph.operators import scan
from impactgraph.operators.graph import cut_lineage

_HEAD = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_NONE = "/dev/null"
#: Places of a block of a hunk or file. A place has one line, so that no block has more rows than some of these.
PLACES = 1 << 16


def _block(place: str) -> Column:
    """Blocks of hunks and files by their places; ranges drawn from a sample would run the plan once more, and write it."""
    return F.floor(F.col(place) / PLACES)


def _path(prefix: str) -> Column:
    """The path of a file header: without its mark, what stands behind a tab, a/ or b/, and the prefix."""
    bare = F.regexp_replace(F.regexp_replace(F.expr("substring(text, 5)"), r"\t.*$", ""), r"\s+$", "")
    return F.when(bare == _NONE, bare).otherwise(F.regexp_replace(bare, "^[ab]/" + (f"(?:{re.escape(prefix)})?" if prefix else ""), ""))


def hunks(diff: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(hunks, body) of diffs (change, n, text).

    hunks: change, hunk, old_file, new_file (null where the side doesn't exist), old_start, old_count, new_start, new_count.
    body: change, hunk, n, side (" ", "-", "+"), text, and open, whether no line break follows on that side. The prefix is
    that of paths above the root of the work.
    """
    head = F.coalesce(F.col("text"), F.lit("")).rlike(_HEAD)
    number = lambda i, empty: F.when(F.regexp_extract("text", _HEAD, i) == "", F.lit(empty)).otherwise(F.regexp_extract("text", _HEAD, i).cast("int"))
    rows = scan.prefix(diff.select("change", "n", F.coalesce("text", F.lit("")).alias("text")), ["change"], ["n"], {"hunk": head.cast("long")}, pos="__at")
    rows = rows.withColumn("head", F.col("text").rlike(_HEAD)).withColumn("hunk", F.col("hunk") + F.col("head").cast("long"))
    mark = F.substring("text", 1, 1)
    old, new = F.when(~F.col("head") & mark.isin("-", " ", ""), 1).otherwise(0), F.when(~F.col("head") & mark.isin("+", " ", ""), 1).otherwise(0)
    counted = scan.prefix(rows.drop("__at"), ["change", "hunk"], ["n"], {"old": old, "new": new}, pos="place", block=_block("n")).withColumns({"wants_old": F.when(F.col("head"), number(2, 1)), "wants_new": F.when(F.col("head"), number(4, 1))})
    counted = cut_lineage(counted)
    wants = counted.where("head").select(F.col("change").alias("c"), F.col("hunk").alias("h"), F.col("wants_old").alias("want_old"), F.col("wants_new").alias("want_new"))
    met = F.col("change").eqNullSafe(F.col("c")) & (F.col("hunk") == F.col("h"))
    inside = ~F.col("head") & F.coalesce((F.col("old") < F.col("want_old")) | (F.col("new") < F.col("want_new")) | (mark == "\\"), F.lit(False))
    placed = cut_lineage(counted.join(wants, met, "left").select("change", "n", "text", "hunk", "head", inside.alias("inside")))
    lines = placed.where("inside")
    # "\ No newline" speaks of the line before it.
    before = scan.prefix(lines, ["change", "hunk"], ["n"], pos="k", block=_block("n"))
    last = before.where(mark == "\\").select(F.col("change").alias("c"), F.col("hunk").alias("h"), (F.col("k") - 1).alias("at"))
    body = before.where(mark != "\\").join(last, F.col("change").eqNullSafe(F.col("c")) & (F.col("hunk") == F.col("h")) & (F.col("k") == F.col("at")), "left")
    side = F.when(mark == "", " ").otherwise(mark)
    body = body.select("change", "hunk", "n", side.alias("side"), F.expr("substring(text, 2)").alias("text"), F.col("at").isNotNull().alias("open"))
    # The files of a hunk are those of the last headers before it.
    heads = placed.where("NOT inside").withColumns({"is_old": F.startswith("text", F.lit("--- ")), "is_new": F.startswith("text", F.lit("+++ "))}).where("head OR is_old OR is_new")
    runs = cut_lineage(scan.prefix(heads, ["change"], ["n"], {"olds": F.col("is_old").cast("long"), "news": F.col("is_new").cast("long")}, pos="__at"))
    names = lambda flag, count, name: runs.where(flag).select(F.col("change").alias(f"c_{name}"), (F.col(count) + 1).alias(f"n_{name}"), F.nullif(_path(prefix), F.lit(_NONE)).alias(name))
    own = runs.where("head").select("change", "hunk", "olds", "news", *[number(i, e).alias(c) for i, e, c in ((1, 0, "old_start"), (2, 1, "old_count"), (3, 0, "new_start"), (4, 1, "new_count"))])
    for flag, count, name in (("is_old", "olds", "old_file"), ("is_new", "news", "new_file")):
        found = names(flag, count, name)
        own = own.join(found, F.col("change").eqNullSafe(F.col(f"c_{name}")) & (F.col(count) == F.col(f"n_{name}"))).drop(f"c_{name}", f"n_{name}")
    return cut_lineage(own.drop("olds", "news")), cut_lineage(body)


def changed_ranges(hunks: DataFrame) -> DataFrame:
    """(change, file, start, end) on the after side; a pure deletion marks one line. Deleted files have none."""
    start = F.greatest("new_start", F.lit(1))
    return hunks.where("new_file IS NOT NULL").select("change", F.col("new_file").alias("file"), start.alias("start"), (start + F.greatest("new_count", F.lit(1)) - 1).alias("end"))


def changed_files(hunks: DataFrame) -> DataFrame:
    """(change, file, old_file, state): added, deleted, renamed or changed; a deleted file by its old path."""
    state = F.when(F.col("new_file").isNull(), "deleted").when(F.col("old_file").isNull(), "added").when(F.col("old_file") != F.col("new_file"), "renamed").otherwise("changed")
    return hunks.select("change", F.coalesce("new_file", "old_file").alias("file"), "old_file", state.alias("state")).distinct()


def base_lines(hunks: DataFrame, body: DataFrame, after: DataFrame) -> DataFrame:
    """(change, file, line, text, open): the lines of every file that a change touched, before it, by its old path.

    after: file, content, as the change left them; files that it deleted needn't be there. open marks a last line without a
    line break. Files that were added had no lines.
    """
    old = hunks.where("old_file IS NOT NULL")
    files = old.select("change", "old_file", "new_file").distinct()
    own = files.join(after.select(F.col("file").alias("new_file"), F.coalesce("content", F.lit("")).alias("content")), "new_file")
    line, text = F.col("at") + 1, F.col("text")
    lines = own.where("content <> ''").select("change", "old_file", "content", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    n = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    lines = lines.withColumn("n", n).where((F.col("at") + 1 < F.col("n")) | (text != "")).select("change", "old_file", (2 * line).alias("place"), line.alias("line"), "text", (line == F.col("n")).alias("open"), *[F.lit(0).cast("long").alias(c) for c in ("step", "inside")])
    # A hunk opens before its first new line and closes behind its last, where the lines behind begin to move.
    edge = lambda place, step, inside: old.select("change", "old_file", place.cast("long").alias("place"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("open"), step.cast("long").alias("step"), inside.cast("long").alias("inside"))
    some = (F.col("new_count") > 0).cast("int")
    first = edge(2 * F.col("new_start") - some, F.lit(0), some)
    behind = edge(2 * (F.col("new_start") + F.greatest(F.col("new_count") - 1, F.lit(0))) + 1, F.col("old_count") - F.col("new_count"), -some)
    order = [F.col("place"), F.col("line").isNull(), F.col("inside"), F.col("step")]
    moved = scan.prefix(lines.withColumn("place", F.col("place").cast("long")).unionByName(first).unionByName(behind), ["change", "old_file"], order, {"moved": F.col("step"), "within": F.col("inside")}, pos="__at", block=_block("place"))
    kept = moved.where("line IS NOT NULL AND within = 0").select("change", F.col("old_file").alias("file"), (F.col("line") + F.col("moved")).alias("line"), "text", "open")
    gone = body.where("side <> '+'")
    placed = scan.prefix(gone, ["change", "hunk"], ["n"], pos="k", block=_block("n"))
    start = old.select(F.col("change").alias("c"), F.col("hunk").alias("h"), F.col("old_file").alias("file"), "old_start")
    cut = placed.join(start, F.col("change").eqNullSafe(F.col("c")) & (F.col("hunk") == F.col("h"))).select("change", "file", (F.col("old_start") + F.col("k")).cast("long").alias("line"), "text", "open")
    return kept.withColumn("line", F.col("line").cast("long")).unionByName(cut)


def base_content(hunks: DataFrame, body: DataFrame, after: DataFrame) -> DataFrame:
    """(change, file, content): the text before the change, of every file that it touched and didn't add."""
    lines = base_lines(hunks, body, after)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.concat("text", F.when(F.col("open"), "").otherwise("\n")).alias("text")))), lambda x: x["text"]), "")
    files = hunks.where("old_file IS NOT NULL").select("change", F.col("old_file").alias("file")).distinct()
    whole = lines.groupBy(F.col("change").alias("c"), F.col("file").alias("f")).agg(text.alias("content"))
    return files.join(whole, F.col("change").eqNullSafe(F.col("c")) & (F.col("file") == F.col("f")), "left").select("change", "file", F.coalesce("content", F.lit("")).alias("content"))
