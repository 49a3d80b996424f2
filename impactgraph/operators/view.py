"""The component view: a quotient of the symbol graph by directory, its cycles, and rules on its edges."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S
from impactgraph.operators import graph


def partitioned(symbols: DataFrame, depth: int = 0, tests: bool = False) -> DataFrame:
    """Symbols with their component; documents never count, test files only if asked for."""
    own = symbols.where(F.col("kind") != "document")
    if not tests:
        own = own.where(~S.is_view_test(F.col("file_path")))
    return own.withColumn("comp", S.component(F.col("file_path"), depth))


def crossings(symbols: DataFrame, edges: DataFrame, depth: int = 0, tests: bool = False) -> DataFrame:
    """Edges of dependency kinds between indexed symbols of different components, with both ends' places."""
    own = partitioned(symbols, depth, tests)
    shown = S.display_name(F.col("qualified_name"), F.col("name"))

    def end(e: str) -> DataFrame:
        return own.select(F.col("id").alias(e), F.col("comp").alias(f"{e}_comp"), shown.alias(f"{e}_symbol"), F.col("file_path").alias(f"{e}_file"), F.col("start").alias(f"{e}_line"))

    found = edges.where(F.col("type").isin(*S.DEPENDENCY_KINDS)).join(end("src"), "src").join(end("dst"), "dst").where("src_comp <> dst_comp")
    return found.withColumn("tier", S.tier(F.col("source")))


_SITE = ("src_file", "src_line", "dst_symbol", "src_symbol", "dst_file", "dst_line", "type", "tier")


def induced(crossed: DataFrame, max_sites: int | None = 5) -> DataFrame:
    """Edges between components: weight, counts by kind and tier, the weakest tier, and the first sites.

    Crossings are first counted by site, which collapses repeated evidence before the rows of a component pair meet, and
    sites are ranked within their pair, so that no pair's sites are gathered beyond the cap. The weight stays whole.
    """
    pair = ["src_comp", "dst_comp"]
    sites = crossed.groupBy(*pair, *_SITE).agg(F.count("*").alias("n"))
    totals = sites.groupBy(*pair).agg(
        F.sum("n").alias("weight"),
        *[F.sum(F.when(F.col("type") == k, F.col("n")).otherwise(0)).alias("n_" + k.replace("-", "_")) for k in S.DEPENDENCY_KINDS],
        *[F.sum(F.when(F.col("tier") == t, F.col("n")).otherwise(0)).alias("n_" + t) for t in S.TIERS],
        F.max(S.tier_rank(F.col("tier"))).alias("weakest"),
    ).withColumn("min_tier", S.tier_of_rank(F.col("weakest"))).drop("weakest")
    if max_sites == 0:
        return totals
    by = W.partitionBy(*pair).orderBy(*_SITE)
    kept = sites
    if max_sites is not None:
        kept = sites.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max_sites)
    times = F.col("n") if max_sites is None else F.least("n", F.lit(max_sites))
    again = F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy")
    kept = kept.select(*pair, *_SITE, again)
    listed = F.array_sort(F.collect_list(F.struct(*_SITE)))
    if max_sites is not None:
        listed = F.slice(listed, 1, max_sites)
    return totals.join(kept.groupBy(*pair).agg(listed.alias("sites")), pair)


def as_maps(induced_edges: DataFrame) -> DataFrame:
    """The same with counts by kind and by tier as maps, which leave out zeros."""
    def packed(names: tuple[str, ...]) -> Column:
        entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col("n_" + k.replace("-", "_")).alias("n")) for k in names])
        return F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0))

    return induced_edges.select("src_comp", "dst_comp", "weight", packed(S.DEPENDENCY_KINDS).alias("kinds"), packed(S.TIERS).alias("tiers"), "min_tier", *[c for c in ("sites",) if c in induced_edges.columns])


def ordered(induced_edges: DataFrame) -> DataFrame:
    return induced_edges.orderBy(F.desc("weight"), "src_comp", "dst_comp")


def tier_summary(induced_edges: DataFrame) -> DataFrame:
    return induced_edges.agg(*[F.coalesce(F.sum("n_" + t), F.lit(0)).alias(t) for t in S.TIERS])


def components(symbols: DataFrame, edges: DataFrame, depth: int = 0, tests: bool = False) -> DataFrame:
    """Each component's files, symbols, exported symbols, and the number of components on either side."""
    own = partitioned(symbols, depth, tests)
    real = F.col("kind") != "file"
    stats = own.groupBy("comp").agg(F.countDistinct("file_path").alias("files"), F.sum(real.cast("long")).alias("symbols"), F.sum((real & F.col("exports")).cast("long")).alias("exported"))
    pairs = crossings(symbols, edges, depth, tests).select("src_comp", "dst_comp").distinct()
    out = pairs.groupBy(F.col("src_comp").alias("comp")).agg(F.count("*").alias("fan_out"))
    into = pairs.groupBy(F.col("dst_comp").alias("comp")).agg(F.count("*").alias("fan_in"))
    return stats.join(into, "comp", "left").join(out, "comp", "left").fillna(0, ["fan_in", "fan_out"])


def component_order(stats: DataFrame) -> DataFrame:
    """Components by name."""
    return stats.orderBy("comp")


def excluded_tests(symbols: DataFrame) -> DataFrame:
    """How many test files the view leaves out."""
    return symbols.where((F.col("kind") != "document") & S.is_view_test(F.col("file_path"))).agg(F.countDistinct("file_path").alias("test_files"))


def expand(crossed: DataFrame, src: str, dst: str) -> DataFrame:
    """All sites of one induced edge, in order."""
    return crossed.where((F.col("src_comp") == src) & (F.col("dst_comp") == dst)).select(*_SITE)


def cycles(pairs: DataFrame) -> DataFrame:
    """(component, cycle): members of each set of components that reach each other; a cycle is named by its least member."""
    return graph.cycles(pairs.select(F.col("src_comp").alias("a"), F.col("dst_comp").alias("b"))).withColumnRenamed("id", "component")


def cycle_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The induced edges inside each cycle."""
    a = members.select(F.col("component").alias("src_comp"), "cycle")
    b = members.select(F.col("component").alias("dst_comp"), F.col("cycle").alias("other"))
    return pairs.join(a, "src_comp").join(b, "dst_comp").where("cycle = other").drop("other")


@dataclass(frozen=True)
class Rule:
    raw: str
    src: str
    dst: str


_RULE = re.compile(r"\s*(?P<src>[^#]*?)\s*->\s*(?P<dst>[^#]*?)\s*(?:#.*)?", re.DOTALL)


def parse_rules(texts: list[str]) -> list[Rule]:
    """Rules of the shape `<from> -> <to>`, with a comment behind # if need be. All bad ones are told in one error: to go
    on without them would let through what they forbid."""
    found = [(t, _RULE.fullmatch(t)) for t in texts]
    bad = [repr(t) for t, m in found if not m or not m["src"] or not m["dst"]]
    if bad:
        raise ValueError(f"not of the shape FROM -> TO: {', '.join(bad)}")
    return [Rule(t.split("#")[0].strip(), m["src"], m["dst"]) for t, m in found]


def violations(spark: SparkSession, induced_edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """Induced edges that a rule forbids. Rules are the caller's own short list and are broadcast."""
    rows = [(r.raw, r.src, r.dst, S.glob_regex(r.src), S.glob_regex(r.dst)) for r in rules]
    table = F.broadcast(spark.createDataFrame(rows, "rule string, rule_src string, rule_dst string, src_glob string, dst_glob string"))
    match = S.matches_component(F.col("rule_src"), F.col("src_glob"), F.col("src_comp")) & S.matches_component(F.col("rule_dst"), F.col("dst_glob"), F.col("dst_comp"))
    return induced_edges.join(table, match).drop("rule_src", "rule_dst", "src_glob", "dst_glob")


def rules_verdict(found: DataFrame, strict: bool = False) -> DataFrame:
    """pass without violations, review if all rest on heuristic evidence (fail when strict), else fail."""
    firm = F.coalesce(F.sum((F.col("min_tier") != "heuristic").cast("long")), F.lit(0))
    n = F.count("*")
    return found.agg(n.alias("violations"), F.when(n == 0, "pass").when((firm > 0) | F.lit(strict), "fail").otherwise("review").alias("verdict"))
