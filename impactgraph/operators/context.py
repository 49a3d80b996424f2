"""Questions that put the other operators together: context for terms, node views, notes, and summaries of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impactgraph.functions import scalars as S
from impactgraph.operators import graph, lookup, select, text

#: Symbols that terms and hits put forward at most, of which the best are chosen: a top-k report.
MOST = 200


def file_symbols(symbols: DataFrame, path: str) -> DataFrame:
    """Symbols of exactly this file; the predicate reaches the scan."""
    return symbols.where(F.col("file_path") == path)


def without_generated(symbols: DataFrame, always: list[str], marked: list[str], marker: str) -> DataFrame:
    """Symbols but for those of generated files: `always` by path, `marked` only where their text holds the marker."""
    path = F.regexp_replace("file_path", r"^\./", "")
    body = F.when(F.col("raw_text") != "", F.col("raw_text")).otherwise(F.col("docstring"))
    return symbols.where(~(path.isin(*always) | (path.isin(*marked) & F.contains(body, F.lit(marker)))))


def candidates(symbols: DataFrame, edges: DataFrame, lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, pos, seed, neighbor): symbols that terms name, those that hits lie in, and their call neighbours.

    Seeds by name come first, confirmed ones ahead; then symbols that text hits promote, MOST in all; then one hop of calls.
    """
    named = graph.cut_lineage(lookup.term_seeds(symbols, terms))
    found = text.merged(lines.join(F.broadcast(terms), F.contains(F.lower("text"), F.lower("term"))))
    spans = symbols.select(F.col("file_path").alias("file"), "id", "start", "end")
    classes = graph.cut_lineage(text.seeds_from_hits(found.select("file", "line", "text"), spans, named))
    confirmed = classes.where("class = 'confirmed'").select(F.col("symbol").alias("id"))
    first = text.confirmed_first(named, confirmed).select("id", F.when(F.col("confirmed"), F.col("pos")).otherwise(F.col("pos") + 100_000).alias("pos"))
    promoted = classes.where("class = 'promoted'").select(F.col("symbol").alias("id"), F.lit(200_000).alias("pos"))
    merged = lookup.first_by_id(first.unionByName(promoted)).orderBy("pos", "id").limit(MOST)
    ranked = merged.withColumn("rank", F.row_number().over(select.W.orderBy("pos", "id")) - 1).select("id", F.col("rank").alias("pos"), (F.col("rank") < select.SEEDS).alias("seed"))
    ranked = graph.cut_lineage(ranked)
    near = graph.call_neighbors(edges, symbols, ranked.where("seed").select("id")).select(F.col("neighbor").alias("id")).distinct().withColumn("neighbor", F.lit(True))
    both = ranked.join(near, "id", "full_outer")
    return both.select("id", F.coalesce("pos", F.lit(1000)).alias("pos"), F.coalesce("seed", F.lit(False)).alias("seed"), F.coalesce("neighbor", F.lit(False)).alias("neighbor"))


def select_context(symbols: DataFrame, edges: DataFrame, lines: DataFrame, terms: DataFrame, stats: DataFrame, seen: DataFrame, budget: int, profile: str = "default") -> DataFrame:
    """The ranked, budgeted context of some terms: (id, score, category, disclosure, cost).

    symbols: as the selection operators need them, with `calls`, the number of call sites. stats: file, last_edit_days,
    commits_90d. seen: file, confidence of what the session was sent. Seeds stand in full and free; the rest competes for
    the budget of its category.
    """
    placed = graph.cut_lineage(select.graph_distance(candidates(symbols, edges, lines, terms)))
    rows = placed.join(symbols, "id").withColumn("file", F.col("file_path"))
    category = S.category(F.col("file_path"), F.col("kind"), F.col("docstring"), F.col("signature"), F.col("raw_text"))
    rows = select.included(rows.withColumn("category", F.when(F.col("seed"), "target").otherwise(category)))
    scored = select.signals(rows.withColumn("tested", F.lit(0.0)), stats).withColumn("score", select.score(profile))
    scored = scored.join(seen.select("file", "confidence", F.lit(True).alias("seen")), "file", "left").fillna({"confidence": "", "seen": False})
    scored = scored.withColumn("trivial", S.is_trivial(F.col("kind"), F.col("start"), F.col("end"), F.col("calls"))).withColumn("wanted", select.disclosure())
    for level in ("full", "signature", "reference"):
        scored = scored.withColumn(f"cost_{level}", S.tokens(select.rendered(F.lit(level))))
    scored = graph.cut_lineage(scored)
    chosen = select.select(scored.where("NOT seed"), budget)
    return select.seeds_free(scored.where("seed")).unionByName(chosen.select("id", "score", "category", "disclosure", "cost"))


def node_view(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """A file's symbols and who depends on it, or a symbol and its edges: (section, id, file_path, detail)."""
    own = file_symbols(symbols, name)
    if not own.isEmpty():
        listed = own.select(F.lit("symbol").alias("section"), "id", "file_path", "kind")
        users = graph.dependents(edges, name).select(F.lit("dependent").alias("section"), F.lit("").alias("id"), F.col("file").alias("file_path"), F.lit("").alias("kind"))
        return listed.unionByName(users).withColumnRenamed("kind", "detail")
    best = lookup.lookup(symbols, name)
    listed = best.select(F.lit("symbol").alias("section"), "id", "file_path", F.col("kind").alias("detail"))
    near = graph.neighbors(edges, symbols, best.select("id"), kinds=S.EDGE_KINDS)
    return listed.unionByName(near.select(F.lit("edge").alias("section"), F.col("neighbor").alias("id"), "file_path", F.concat_ws(" ", "type", "direction").alias("detail")))


def change_impact_or_callers(symbols: DataFrame, edges: DataFrame, attempts: list[tuple[str | None, str]]) -> DataFrame:
    """The first attempt (type, member) that finds a declaration; else the callers of functions by the last one's name."""
    for type_name, member in attempts:
        found = graph.change_impact(symbols, edges, type_name, member)
        if not found.where("role = 'declaration'").isEmpty():
            return found
    bare = symbols.where(F.col("name") == attempts[-1][1]).select("id")
    calls = graph.callers(edges, symbols, bare).select(F.col("neighbor").alias("id")).distinct()
    return calls.join(symbols.select("id", "file_path", "name", "start"), "id").withColumn("role", F.lit("caller"))


def structural_note(found: DataFrame, real_symbols: int, family: int = 4, callers: int = 3) -> DataFrame:
    """One row with the sizes of a change set and its first members, where exactly one real symbol has a family or two callers."""
    names = lambda role, n: F.slice(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("name")))), 1, n)
    size = lambda role: F.sum((F.col("role") == role).cast("long"))
    note = found.agg(size("family").alias("family"), size("caller").alias("callers"), names("family", family).alias("first_family"), names("caller", callers).alias("first_callers"))
    return note.where(((F.col("family") > 0) | (F.col("callers") >= 2)) & F.lit(real_symbols == 1))


def result_summary(found: DataFrame, shown: int = 10) -> DataFrame:
    """Per role of a result: how many rows, and the first names, which is what a pointer to it tells."""
    return found.groupBy("role").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("name")), 1, shown).alias("names"))


def pointer_summary(payload: dict) -> dict:
    """Lengths of a result's lists, and the scalars that identify it."""
    kept = {k: len(v) for k, v in payload.items() if isinstance(v, list)}
    return kept | {k: payload[k] for k in ("query", "completeness", "newName", "scope") if k in payload}


def canonical(payload: dict) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def with_stale_warning(result: DataFrame, failure: str | None) -> DataFrame:
    """A result with the reason why the index behind it may be old, if there is one."""
    return result.withColumn("stale_warning", F.lit(failure).cast(T.StringType()))


def prune(entries: DataFrame, now, days: int = 30) -> DataFrame:
    """Saved ledgers (name, modified) that are old enough to delete."""
    return entries.where((F.unix_timestamp(now) - F.unix_timestamp("modified")) > days * 86400)
