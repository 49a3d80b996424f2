"""Mixing sources to target weights by hierarchical budgeting.

Sources are leaves of a tree, domain - language - source. A node's capacity is what its leaves hold, times the epochs
allowed. The total budget goes down the tree: a parent's is split among its children by weight; a child that can't use its
share takes its capacity, and its shortage goes to its siblings by their weights. As no parent gets more than it can
hold, shortages are settled among siblings before an ancestor sees them.

A leaf takes whole epochs as far as its budget goes, then the longest prefix, in tokens, of one more epoch in seeded
order. The order is cut into STEPS ranges of a hash; only the range in which a prefix ends is ordered row by row, so that a
leaf with a third of all rows is no single task.

Null levels are a value of their own, the empty string. A text's tokens are estimated as a fourth of its UTF-8 bytes, 0
for a null or empty text, else 1 at least. Rows with one id are drawn one by one. Empty tables and budgets give 0 copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.llm.common import Scratch, few, numbered

STEPS_BITS = 12
LEVELS = ("__domain", "__lang", "__source")


def domain(source: Column) -> Column:
    """A mapping of sources to domains for corpora whose sources are numbered: by the last character. Others pass their own."""
    last = F.substring(F.coalesce(source, F.lit("")), -1, 1)
    return F.when(last.isin("0", "1", "2"), "web").when(last.isin("3", "4", "5"), "books").otherwise("other")


#: Weights of the first two levels; names that aren't listed, and all sources, weigh 1.
WEIGHTS = {"__domain": {"web": 6, "books": 3}, "__lang": {"en": 4, "de": 2, "fr": 2}, "__source": {}}
#: Share of all tokens that the mixture has; epochs of a leaf at most; the seed of their orders.
SHARE, EPOCHS, SEED = 0.6, 2, 11


def _order(epoch: Column, seed: int) -> Column:
    """60 bits of md5(seed:epoch:doc_id)."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Children with `capacity`, `weight` and their parent's `budget`; budget becomes each child's own.

    Sorted by capacity per weight, children are full up to the first whose share of what is left is less than it holds.
    """
    key = [F.coalesce(c, F.lit("")) if isinstance(c, Column) else F.col(c) for c in parent] or [F.lit(0)]
    by = W.partitionBy(*key).orderBy(F.col("capacity") / F.col("weight"), child)
    before = F.coalesce(F.sum("capacity").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("weight").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = nodes.withColumn("level", (F.col("budget") - before) / behind)
    open_ = F.when(F.col("capacity") / F.col("weight") > F.col("level"), F.col("level"))
    level = level.withColumn("cut", F.first(open_, True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    full = F.col("cut").isNull() | (F.col("capacity") / F.col("weight") <= F.col("level"))
    return level.withColumn("budget", F.when(full, F.col("capacity")).otherwise(F.col("weight") * F.col("cut"))).drop("level", "cut")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """leaves: LEVELS and tokens. Adds `budget`, in tokens, rounded down."""
    tree = leaves.where("tokens > 0").withColumn("capacity", (F.col("tokens") * epochs).cast("double"))
    nodes, path = None, []
    for level in LEVELS:
        own = tree.groupBy(*path, level).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(level, weights))
        if nodes is None:
            own = own.withColumn("budget", F.floor(F.sum("tokens").over(W.partitionBy(F.lit(0))) * F.lit(share)).cast("double"))
        else:
            own = own.join(nodes.select(*path, "budget"), path)
        nodes = split(own, path, level)
        path.append(level)
    return nodes.select(*LEVELS, "tokens", F.floor("budget").cast("long").alias("budget"))


def copies(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, weights: dict = WEIGHTS, domain_of: Callable[[Column], Column] = domain) -> DataFrame:
    """(doc, LEVELS, __tokens, __copies): how often each document is drawn; doc has all columns of docs, whatever their names.

    domain_of gives a source's domain. Documents are ordered row by row without their texts, in the one range of each leaf
    in which its prefix ends.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    text = F.coalesce("doc.text", F.lit(""))
    size = F.octet_length(text)
    rows = numbered(docs, scratch).select(
        "row_key", "doc", domain_of(F.col("doc.source")).alias("__domain"), F.coalesce("doc.lang", F.lit("")).alias("__lang"), F.coalesce("doc.source", F.lit("")).alias("__source"), F.col("doc.doc_id").alias("__id"),
        F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4))).cast("long").alias("__tokens"),
    )
    slim = scratch.write(rows.select(*LEVELS, "__id", "__tokens"), "sizes")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("__tokens").alias("tokens"))
    plan = budgets(leaves, share, epochs, weights).withColumn("__full", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    plan = scratch.write(plan.select(*LEVELS, "__full", (F.col("budget") - F.col("__full") * F.col("tokens")).alias("__rest")), "plan")
    small = few(plan)
    plan = F.broadcast(plan) if small else plan
    step = F.shiftright("__at", 60 - STEPS_BITS)
    steps = slim.join(plan, list(LEVELS)).withColumn("__at", _order(F.col("__full"), seed)).groupBy(*LEVELS, "__rest", step.alias("__step")).agg(F.sum("__tokens").alias("t"))
    by = W.partitionBy(*LEVELS).orderBy("__step")
    # The first range that the rest of the budget doesn't hold whole, and what is left for it.
    ends = steps.withColumn("sum", F.sum("t").over(by)).where(F.col("sum") > F.col("__rest")).groupBy(*LEVELS).agg(F.min("__step").alias("__end"), F.min_by(F.col("__rest") - F.col("sum") + F.col("t"), "__step").alias("__left"))
    cut = scratch.write(plan.select(*LEVELS, "__full").join(ends, list(LEVELS), "left"), "cut")
    cut = F.broadcast(cut) if small else cut
    drawn = rows.join(cut, list(LEVELS), "left").withColumn("__at", _order(F.coalesce("__full", F.lit(0)), seed)).withColumn("__step", step)
    inside = F.coalesce(F.col("__step") == F.col("__end"), F.lit(False))
    out = ["doc", *LEVELS, "__tokens"]
    more = F.col("__full").isNotNull() & (F.col("__end").isNull() | (F.col("__step") < F.col("__end")))
    far = drawn.where(~inside).select(*out, (F.coalesce("__full", F.lit(0)) + F.when(more, 1).otherwise(0)).alias("__copies"))
    close = drawn.where(inside)
    ids = close.select("row_key", *LEVELS, "__at", "__id", F.md5(text).alias("__tie"), "__tokens", "__left", "__full")
    order = W.partitionBy(*LEVELS).orderBy("__at", "__id", "__tie", "__tokens").rowsBetween(W.unboundedPreceding, 0)
    near = scratch.write(ids.select("row_key", (F.col("__full") + F.when(F.sum("__tokens").over(order) <= F.col("__left"), 1).otherwise(0)).alias("__copies")), "near")
    near = close.join(F.broadcast(near) if few(near) else near, "row_key").select(*out, "__copies")
    return far.unionByName(near).withColumn("__copies", F.col("__copies").cast("long"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The drawn rows, one for each copy, with the columns of docs."""
    got = copies(docs, **settings).where("__copies > 0")
    return got.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("copy")).select("doc.*")
