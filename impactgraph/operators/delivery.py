"""Delivered text for many queries: windows of source lines, by file and rank, within a budget.

Nothing is one task's alone: files are ranked, lines summed and sections budgeted by prefix sums in two levels. Only lines
that the hard limit leaves room for become text, so that a section's size is known before, and however long the file
is, its text is bounded by the budget.

A file that isn't there is `missing` and takes no place. Null contents are empty files. Queries without picks have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S
from impactgraph.operators import scan, select
from impactgraph.operators.graph import cut_lineage

#: Tokens that a section is cut to at least.
LEAST = 200


def deliver(picked: DataFrame, files: DataFrame, budget: int, most: int = select.MAX_FILES, heads: DataFrame | None = None, delivered: DataFrame | None = None) -> DataFrame:
    """(query, file, rank, state, cost, text): what each query's answer shows of each of its picked files.

    picked: query, file, start, end, full, category, score, pos; tests aren't shown. files: file, content, a row each.
    heads: query and tokens that its answer has before the sections. delivered: query, file and content_hash (SHA-256) of files
    that were delivered whole; they are pointers while unchanged.

    Files go by their best score, then pos. `most` are shown, until the budget is spent; a section that would pass twice the
    budget ends the answer, but for the first, which is cut at a line. States: whole, windows, pointer, cut, listed
    (not shown) and missing; the last two have no text and cost nothing.
    """
    hard = 2 * budget
    picked = picked.where("category <> 'test' AND file <> '' AND start > 0")
    order = select.file_order(picked, most, "query").select("query", "file", "rank")
    sizes = files.select("file", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), _count().alias("lines"))
    there = cut_lineage(order.join(sizes, "file", "left"))
    # Only so many files as may be shown are rendered.
    real = scan.prefix(there.where("lines IS NOT NULL"), ["query"], ["rank"], pos="nth").where(F.col("nth") < most)
    if delivered is not None:
        same = delivered.select("query", "file", "content_hash").distinct().withColumn("pointer", F.lit(True))
        real = real.join(same, ["query", "file", "content_hash"], "left").withColumn("pointer", F.coalesce("pointer", F.lit(False)))
    else:
        real = real.withColumn("pointer", F.lit(False))
    if heads is not None:
        real = real.join(heads.select("query", F.col("tokens").alias("head")), "query", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    else:
        real = real.withColumn("head", F.lit(0))
    real = cut_lineage(real)
    wins = cut_lineage(_windows(picked, real))
    pieces = cut_lineage(scan.prefix(_pieces(wins, files, real), ["query", "file"], ["at", "kind"], {"bytes": F.octet_length("text")}, pos="__at").drop("__at"))
    size = pieces.groupBy("query", "file").agg(F.max(F.col("bytes") + F.octet_length("text")).alias("size"))
    real = real.join(wins.groupBy("query", "file").agg(F.max("whole").alias("whole")), ["query", "file"], "left")
    costed = real.join(size, ["query", "file"]).withColumn("cost", F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("size") / 4))).cast("long"))
    # The first section may be cut: to the last line end within its room.
    room = F.when((F.col("nth") == 0) & (F.col("head") + F.col("cost") > hard), F.greatest(F.lit(LEAST), F.lit(hard) - F.col("head")) * 4)
    fits = costed.withColumn("room", room).withColumn("room", F.when(F.col("size") > F.col("room"), F.col("room")))
    kept = pieces.join(fits.select("query", "file", "room"), ["query", "file"]).where(F.col("room").isNull() & (F.col("bytes") <= 4 * hard) | (F.col("bytes") + F.octet_length("text") <= F.col("room")) | (F.col("bytes") == 0))
    texts = kept.groupBy("query", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind", "text"))), lambda x: x["text"]), "").alias("text"))
    note = F.concat(F.lit("… [cut "), "file", F.lit(" here to stay within the budget; read the file for the rest]\n\n"))
    sections = fits.join(texts, ["query", "file"]).withColumn("cut", F.col("room").isNotNull()).withColumn("text", F.when(F.col("cut"), F.concat("text", note)).otherwise(F.col("text"))).withColumn("cost", F.when(F.col("cut"), S.tokens(F.col("text"))).otherwise(F.col("cost")))
    spent = scan.prefix(sections, ["query"], ["rank"], {"spent": F.col("cost")}, pos="__at").drop("__at").withColumn("spent", F.col("spent") + F.col("head"))
    over = (F.col("spent") > budget) & (F.col("rank") > 1) | ((F.col("nth") > 0) & (F.col("spent") + F.col("cost") > hard))
    ends = spent.where(over).groupBy("query").agg(F.min("rank").alias("end"))
    state = F.when(F.col("pointer"), "pointer").when(F.col("cut"), "cut").when(F.col("whole"), "whole").otherwise("windows")
    shown = spent.join(ends, "query", "left").where("end IS NULL OR rank < end").select("query", "file", "cost", "text", state.alias("shown"))
    out = there.join(shown, ["query", "file"], "left")
    state = F.coalesce("shown", F.when(F.col("lines").isNull(), "missing").otherwise("listed"))
    return out.select("query", "file", "rank", state.alias("state"), F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), "text")


def _count():
    """Lines of a content; a last line break ends a line and doesn't begin one."""
    n = F.size(F.split(F.coalesce("content", F.lit("")), "\n", -1))
    return F.when(F.coalesce("content", F.lit("")) == "", 0).otherwise(n - F.endswith("content", F.lit("\n")).cast("int"))


def _windows(picked: DataFrame, real: DataFrame) -> DataFrame:
    plain = real.where("NOT pointer")
    spans = picked.join(plain.select("query", "file"), ["query", "file"], "left_semi").select("query", "file", "start", "end", "full")
    return select.windows(spans, plain.select("file", "lines").distinct(), "query")


def _pieces(wins: DataFrame, files: DataFrame, real: DataFrame) -> DataFrame:
    """(query, file, at, kind, text): a section's head, lines, marks of what is left out, and its end, each with a line break."""
    plain = real.where("NOT pointer")
    before = F.lag("end").over(W.partitionBy("query", "file").orderBy("start"))
    gaps = wins.withColumn("before", before).where(F.col("start") > F.col("before") + 1)
    mark = F.concat(F.lit("… [lines "), F.col("before") + 1, F.lit("–"), F.col("start") - 1, F.lit(" omitted] …\n"))
    marks = gaps.select("query", "file", F.col("start").alias("at"), F.lit(0).alias("kind"), mark.alias("text"))
    wanted = wins.where("start <= end").select("query", "file", F.explode(F.sequence("start", "end")).alias("at"))
    own = files.join(plain.select("file").distinct(), "file", "left_semi")
    lines = own.select("file", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("at", "line")).withColumn("at", F.col("at") + 1)
    body = wanted.join(lines, ["file", "at"]).select("query", "file", "at", F.lit(1).alias("kind"), F.concat("at", F.lit("\t"), S.clamp_lines(F.col("line")), F.lit("\n")).alias("text"))
    kind = F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)
    heads = plain.select("query", "file", F.lit(0).alias("at"), F.lit(0).alias("kind"), F.concat(F.lit("**`"), "file", F.lit("`**\n\n```"), kind, F.lit("\n")).alias("text"))
    ends = plain.select("query", "file", (F.col("lines") + 1).alias("at"), F.lit(2).alias("kind"), F.lit("```\n\n").alias("text"))
    pointer = F.concat(F.lit("["), "file", F.lit(" unchanged, sha "), S.short_sha(F.col("content_hash")), F.lit("]\n"))
    pointers = real.where("pointer").select("query", "file", F.lit(0).alias("at"), F.lit(0).alias("kind"), pointer.alias("text"))
    return heads.unionByName(marks).unionByName(body).unionByName(ends).unionByName(pointers)
