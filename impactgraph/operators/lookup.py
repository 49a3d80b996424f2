"""Finding symbols by name: search, resolution and ranked lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S


def projected(symbols: DataFrame, fields: list[str]) -> DataFrame:
    """Name, file and line always, and those fields of a symbol that are asked for; unknown ones are ignored."""
    known = {"signature": "signature", "sig": "signature", "doc": "docstring", "docstring": "docstring", "body": "raw_text", "source": "raw_text", "kind": "kind", "parent": "parent", "modifiers": "modifiers"}
    want = list(dict.fromkeys(known[f] for f in fields if f in known and known[f] in symbols.columns))
    return symbols.select("name", "file_path", "start", *want)


def compact_sites(symbols: DataFrame) -> DataFrame:
    return symbols.select("name", S.display_name(F.col("qualified_name"), F.col("name")).alias("qualified_name"), "file_path", F.col("start").alias("line"), "kind")


def first_by_id(rows: DataFrame) -> DataFrame:
    """One row per id: that with the least `pos`."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("pos"))).where("rank = 1").drop("rank")


def _match(symbols: DataFrame, term: str) -> Column:
    t = term.lower()
    name, qualified = F.lower("name"), F.lower("qualified_name")
    body = F.concat_ws(" ", *[F.col(c) for c in ("signature", "docstring") if c in symbols.columns])
    exact, start, part = (name == t) | (qualified == t), name.startswith(t) | qualified.startswith(t), name.contains(t) | qualified.contains(t)
    return F.when(exact, 0).when(start, 1).when(part, 2).when(F.lower(body).contains(t), 3)


def search(symbols: DataFrame, term: str, limit: int = 25) -> DataFrame:
    """Symbols that hold a term, exact names first, then prefixes, parts of names, and other text: a top-k report."""
    return symbols.withColumn("rank", _match(symbols, term)).where("rank IS NOT NULL").orderBy("rank", "name", "file_path", "id").limit(limit)


def did_you_mean(symbols: DataFrame, term: str, most: int = 5) -> DataFrame:
    return search(symbols, term, most) if len(term) >= 3 else symbols.limit(0).withColumn("rank", F.lit(None).cast("int"))


def term_seeds(symbols: DataFrame, terms: DataFrame, limit: int = 5, content_limit: int = 3) -> DataFrame:
    """Seeds of each term: name hits, real symbols before test doubles, then at most content_limit others; deduplicated."""
    t = F.lower("term")
    by_name = F.contains(F.lower("name"), t) | F.contains(F.lower("qualified_name"), t)
    other = F.contains(F.lower(F.concat_ws(" ", *[F.col(c) for c in ("signature", "docstring") if c in symbols.columns])), t)
    found = symbols.join(F.broadcast(terms), by_name | other).withColumn("class", F.when(by_name, F.when(S.is_test_double(F.col("file_path")), 1).otherwise(0)).otherwise(2))
    cls = F.when(F.col("class") == 2, 1).otherwise(0)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("term", cls).orderBy("class", "name", "id"))).where(F.col("rank") <= F.when(F.col("class") == 2, content_limit).otherwise(limit))
    return ranked.groupBy("id").agg(F.min(F.struct("pos", "class", "rank")).alias("x")).select("id", (F.col("x.pos") * 1000 + F.col("x.class") * 100 + F.col("x.rank")).alias("pos"))


def resolve(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of a name: exactly qualified ones alone if there are any; else by leaf, real ones before test doubles."""
    leaf = name.rsplit(".", 1)[-1]
    found = symbols.where((F.col("name") == leaf) | (F.col("qualified_name") == name) | F.col("qualified_name").endswith("." + leaf))
    exact = (F.col("qualified_name") == name) & F.lit("." in name)
    found = found.withColumn("exact", exact).withColumn("any_exact", F.max(exact).over(W.partitionBy(F.lit(0)))) if "." in name else found.withColumn("exact", F.lit(False)).withColumn("any_exact", F.lit(False))
    rank = F.when(F.col("qualified_name") == name, 0).when(~S.is_test_double(F.col("file_path")), 1).otherwise(2)
    return found.where(~F.col("any_exact") | F.col("exact")).drop("exact", "any_exact").withColumn("rank", rank).orderBy("rank", "file_path", "id")


def score(name: str) -> Column:
    """Lookup score of a symbol for a dotted or bare name, null if it doesn't match: qualified and leaf matches, a package
    hint (granted when none is given), and less for test doubles."""
    parts = name.split(".")
    hint, leaf = "", name
    at = name.rfind(".")
    if at > 0 and "/" not in name[at + 1 :]:
        leaf, hint = name[at + 1 :], name[:at]
    typed = f"{parts[-2]}.{parts[-1]}" if len(parts) >= 2 and "/" not in parts[-1] else ""
    base = F.when(F.col("qualified_name") == typed, 1000) if typed else F.when(F.lit(False), 0)
    base = base.when(F.col("qualified_name") == leaf, 500).when(F.col("name") == leaf, 1)
    folder = S.directory(F.col("file_path"))
    package = F.lit(True) if not hint else (folder == hint) | F.endswith(F.lit(hint), F.concat(F.lit("/"), folder))
    return base + F.when(package, 100).otherwise(0) - F.when(S.is_test_double(F.col("file_path")), 10).otherwise(0)


def lookup(symbols: DataFrame, name: str, file: str = "") -> DataFrame:
    """The best symbols of a name: all that tie at the top, `ambiguous` when they are several.

    A file hint narrows candidates, unless nothing would be left.
    """
    leaf = name.rsplit(".", 1)[-1]
    near = symbols.where(F.col("name").contains(leaf) | F.col("qualified_name").contains(leaf)).withColumn("score", score(name)).where("score IS NOT NULL")
    if file:
        near = near.withColumn("hinted", F.contains(F.lower("file_path"), F.lit(file.lower())).cast("int"))
        best = near.agg(F.max("hinted").alias("top"))
        near = near.join(F.broadcast(best), F.col("hinted") == F.col("top")).drop("hinted", "top")
    top = near.agg(F.max("score").alias("best"))
    tied = near.join(F.broadcast(top), F.col("score") == F.col("best")).drop("best")
    n = tied.agg((F.count("*") > 1).alias("ambiguous"))
    return tied.join(F.broadcast(n))
