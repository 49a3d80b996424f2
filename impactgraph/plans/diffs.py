"""Queries on diffs: texts before a change from the texts after it and the diff between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactgraph.operators import verify
from impactgraph.plans.catalog import query
from impactgraph.sources import adapters as A
from impactgraph.sources import patches


def edited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(diff, after): an edit of every document, as a change for each language.

    By doc_id and line, lines go, change, or get a line behind them; every tenth document is deleted, every tenth is new.
    """
    docs = A.table(spark, sf, "documents").where("coalesce(text, '') <> ''").select("doc_id", F.coalesce("lang", F.lit("")).alias("change"), A.document_file().alias("file"), "text")
    way = F.pmod("doc_id", F.lit(10))
    lines = docs.select("doc_id", "change", "file", way.alias("way"), F.endswith("text", F.lit("\n")).alias("ended"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"), F.size(F.split("text", "\n", -1)).alias("n"))
    lines = lines.withColumn("n", F.col("n") - F.col("ended").cast("int")).where("at < n").withColumn("i", F.col("at") + 1)
    open_ = ~F.col("ended") & (F.col("i") == F.col("n"))
    rule = F.pmod(F.col("doc_id") + F.col("i"), F.lit(7))
    kind = F.when(rule == 0, "gone").when(rule == 3, "other").when((rule == 5) & (F.col("i") < F.col("n")), "more").otherwise("same")
    lines = lines.withColumn("open", open_).withColumn("kind", F.when(F.col("way") == 9, "deleted").when(F.col("way") == 8, "new").otherwise(kind))
    moved = F.coalesce(F.sum(F.when(F.col("kind") == "more", 1).when(F.col("kind") == "gone", -1).otherwise(0)).over(W.partitionBy("doc_id", "file").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("at", F.col("i") + moved)
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    i, at, n, line = F.col("i"), F.col("at"), F.col("n"), F.col("line")
    end = F.when(F.col("open"), F.lit("\\ No newline at end of file"))
    rows = F.when(F.col("kind") == "gone", F.array(text("@@ -", i, ",1 +", at - 1, ",0 @@"), text("-", line), end)).when(F.col("kind") == "other", F.array(text("@@ -", i, " +", at, " @@ a b"), text("-", line), end, text("+", line, "!"), end)).when(F.col("kind") == "more", F.array(text("@@ -", i, ",0 +", at + 1, ",1 @@"), text("+-- ", i)))
    rows = rows.when(F.col("kind") == "deleted", F.array(F.when(i == 1, text("@@ -1,", n, " +0,0 @@")), text("-", line), end)).when(F.col("kind") == "new", F.array(F.when(i == 1, text("@@ -0,0 +1,", n, " @@")), text("+", line), end))
    head = F.array(text("diff --git a/", F.col("file"), " b/", F.col("file")), F.when(F.col("way") == 8, "--- /dev/null").otherwise(text("--- a/", F.col("file"))), F.when(F.col("way") == 9, "+++ /dev/null").otherwise(text("+++ b/", F.col("file"))))
    place = lambda i: F.col("doc_id") * (1 << 28) + i * 8
    body = lines.where("kind <> 'same'").select("change", place(i).alias("base"), F.posexplode(rows).alias("k", "text"))
    heads = lines.where("kind <> 'same'").select("change", "doc_id", "file", "way").distinct().select("change", place(F.lit(0)).alias("base"), F.posexplode(head).alias("k", "text"))
    diff = body.unionByName(heads).where("text IS NOT NULL").select("change", (F.col("base") + F.col("k")).alias("n"), "text")
    ended = F.when(F.col("open"), "").otherwise("\n")
    kept = F.when(F.col("kind") == "gone", F.lit("")).when(F.col("kind") == "other", F.concat(line, F.lit("!"), ended)).when(F.col("kind") == "more", F.concat(line, F.lit("\n-- "), i, F.lit("\n"))).otherwise(F.concat(line, ended))
    after = lines.where("way <> 9").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", kept.alias("t")))), lambda x: x["t"]), "").alias("content"))
    return diff, after


_EDITED = """WITH d AS (SELECT doc_id, doc_id % 10 AS way, coalesce(lang, '') AS change, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id AS VARCHAR)) AS file, text, len(string_split(text, chr(10))) - (text LIKE '%' || chr(10))::INT AS n FROM documents WHERE coalesce(text, '') <> ''),
    e AS (SELECT *, CASE way WHEN 9 THEN 'deleted' WHEN 8 THEN 'added' ELSE 'changed' END AS state FROM d WHERE way >= 8 OR len(list_filter(range(1, n + 1), lambda i: (doc_id + i) % 7 IN (0, 3) OR ((doc_id + i) % 7 = 5 AND i < n))) > 0) """


@query(_EDITED + "SELECT change, file, sha256(text) AS content_sha256 FROM e WHERE way <> 8")
def base_content(spark, sf):
    """The documents themselves, from their edited texts and the diff."""
    diff, after = edited(spark, sf)
    hunks, body = patches.hunks(diff)
    return patches.base_content(hunks, body, after).select("change", "file", F.sha2("content", 256).alias("content_sha256"))


@query(_EDITED + "SELECT change, file, state FROM e")
def changed_files(spark, sf):
    return patches.changed_files(patches.hunks(edited(spark, sf)[0])[0]).select("change", "file", "state")


@query(_EDITED + """, s AS (SELECT 'b' || b AS name, file, CASE b % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'const' ELSE 'document' END AS kind FROM (SELECT file, unnest(range(0, 1 + n // 8)) AS b, n FROM e WHERE way = 9 AND n > 2))
    SELECT name, file, 'removed with file' AS because, CASE kind WHEN 'function' THEN 'seed' ELSE 'unverified' END AS state FROM s WHERE kind <> 'document'
    UNION ALL SELECT file, file, 'removed with file', 'unverified' FROM e WHERE way = 9 AND n <= 2""")
def removed_with_files(spark, sf):
    """What deleted documents declared: a function, a constant or a text for each eight lines of their base content; short ones
    declare nothing that is known."""
    diff, after = edited(spark, sf)
    hunks, body = patches.hunks(diff)
    base = patches.base_lines(hunks, body, after).groupBy("file").agg(F.count("*").alias("n")).where("n > 2")
    own = base.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 8))).alias("b"))
    kind = F.when(F.col("b") % 3 == 0, "function").when(F.col("b") % 3 == 1, "const").otherwise("document")
    return verify.removed_with_file(own.select(F.concat(F.lit("b"), "b").alias("name"), "file", kind.alias("kind")), patches.changed_files(hunks))


@query("""WITH m AS (SELECT 'r' || n_regionkey || '.ts' AS file, n_name AS block, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    c AS (SELECT file, block, bool_or(k % 5 = 0) AS told FROM m GROUP BY ALL)
    SELECT 'op' || k AS name, file, block, 'member' AS because, 'seed' AS state, 'a: int, b: Map<K, V>' AS params, 'a: int' AS new_params FROM m WHERE k % 5 = 0
    UNION ALL SELECT block, file, block, 'block', 'unverified', '', '' FROM c WHERE NOT told""")
def block_member_seeds(spark, sf):
    """Nations are interfaces of their region's file, suppliers their members; some change their parameters, some what they
    return, and some are gone or new."""
    n, s = A.table(spark, sf, "nation"), A.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    own = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("r"), "n_regionkey", F.lit(".ts")).alias("file"), F.col("n_name").alias("block"), "n_nationkey", key)
    at = lambda step: (F.col("n_nationkey") * 10_000_000 + key * step).cast("int").alias("line")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    before = own.select("file", at(2), text("  op", key, "(a: int,  b: Map<K, V>): void;").alias("text")).union(own.select("file", (F.col("n_nationkey") * 10_000_000 + key * 2 + 1).cast("int"), text("  // op", key, "(a: old)")))
    way = key % 5
    shown = F.when(way == 0, text("op", key, "(a: int): void;")).when(way == 1, text("op", key, "(a: int, b: Map<K, V>): number;")).when(way == 2, text("new", key, "(x: int): void;")).otherwise(text("op", key, "(a: int, b: Map<K, V>): void;"))
    after = own.select("file", at(3), shown.alias("text"))
    spans = own.groupBy("file", "block", "n_nationkey").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    place = F.col("n_nationkey") * 10_000_000
    changed = spans.select("file", "block", *[(place + F.col(c) * step).cast("int").alias(name) for c, step, name in (("a", 2, "start0"), ("b", 2, "end0"), ("a", 3, "start1"), ("b", 3, "end1"))])
    return verify.block_seeds(before, after, changed)
