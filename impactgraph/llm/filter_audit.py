"""What each quality filter removes, in every order in which the filters may run.

A document's failures are one bit mask. Documents are counted by part, mask and label; these cells are at most 2^n a part,
whatever the size of the corpus. Each cell is unpivoted against the steps of all n! orders; a running bit-or over the steps
before tells whether the document is gone already; conditional sums over the cells give a step's counts, and a window over
all steps of one filter gives its share in all orders.

The copy filter holds for a document whose text stands under a smaller doc_id anywhere in the table. Equal texts fail the
other filters alike, so that a text's rows are counted by part and label first, and only those counts are compared: a text
that a third of all rows share is a handful of rows by then. Texts are equal when their SHA-256 is.

Null texts are empty. Rows without an id have no labels and are no copies. Rows with one id count one by one, and copies
of each other they are not. A document has a label if any label row of its id has. Null parts are the empty string. An
empty table has no parts, hence no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: n filters have n! orders of n steps: 720 x 6 rows a part with six.
MOST_FILTERS = 6
#: White space between words.
WHITE = r"[\x20\x09-\x0D]+"

#: A filter's condition of failure, of a text and its words.
Failure = Callable[[Column, Column], Column]
FAILURES: dict[str, Failure] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
}
#: The filter that fails copies.
COPY = "E"


def _letters(failures: dict[str, Failure], copy: str | None) -> list[str]:
    letters = sorted([*failures, *([copy] if copy else [])])
    if not 1 <= len(letters) <= MOST_FILTERS or any(len(x) != 1 for x in letters) or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one character each: {letters}")
    return letters


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", failures: dict[str, Failure] = FAILURES, copy: str | None = COPY) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters; bit i of mask is the i-th name in order."""
    bit = {x: 1 << i for i, x in enumerate(_letters(failures, copy))}
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = split.withColumn("words", F.filter(F.split("text", WHITE), lambda w: w != ""))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), bit[x]).otherwise(0) for x, fails in failures.items()), F.lit(0))
    rows = split.select("doc_id", "part", mask.cast("int").alias("mask"), (F.unhex(F.sha2("text", 256)) if copy else F.lit(None).cast("binary")).alias("h"))
    holds = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(holds("quality").alias("good"), holds("toxic").alias("toxic"))
    # Labels grow with the documents: always a merge join, whatever their size. Rows without an id don't meet in one task.
    named = rows.where("doc_id IS NOT NULL").join(marks.hint("merge"), "doc_id", "left")
    rows = named.unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True).na.fill(False, ["good", "toxic"])
    if copy:
        same = rows.groupBy("h", "part", "mask", "good", "toxic", "doc_id").agg(F.count("*").alias("n"))
        named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
        same = same.groupBy("h", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(named).alias("least"))
        # Rows of the text's least id are no copies. A text's rows here are at most one for each part and label.
        first = F.when(F.col("least.doc_id") == F.min("least.doc_id").over(W.partitionBy("h")), F.col("least.n")).otherwise(0)
        same = same.withColumn("own", F.col("unnamed") + F.coalesce(first, F.lit(0)))
        kinds = F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(bit[copy]).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
        rows = same.select("part", "good", "toxic", F.inline(kinds)).where("n > 0")
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    having = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), having("good"), having("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", failures: dict[str, Failure] = FAILURES, copy: str | None = COPY) -> DataFrame:
    """For each part, filter_order and step: the filter, and how many documents are

    kept after it, removed by it, redundant (fail it, but gone before), unique_fails (fail it alone), good_lost and
    toxic_lost (removed by it, with that label); shapley is what the filter removes in all orders together.
    """
    letters = _letters(failures, copy)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    step = F.posexplode(F.split("filter_order", "")).alias("step", "filter")
    bits = F.create_map(*[x for i, name in enumerate(letters) for x in (F.lit(name), F.lit(1 << i))])
    # The cells are few and dear: they are made once, before they are repeated for each order and step.
    long = cells(docs, labels, part, failures, copy).withColumn("filter_order", F.explode(orders)).select("*", step).withColumn("bit", bits[F.col("filter")])
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("failed", failed).withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda condition, measure, name: F.sum(F.when(condition, F.col(measure)).otherwise(0)).cast("long").alias(name)
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"), total(fails & (F.col("mask") == F.col("bit")), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"), total(fails & ~gone, "toxic", "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter"))).withColumn("step", (F.col("step") + 1).cast("int"))
