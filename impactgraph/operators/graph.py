"""Neighbours, reachability and sets of symbols that change together.

Reachability runs in rounds: the frontier joins the edges, and nodes already seen drop out. Each round is written to the
shared checkpoint folder, so that plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names; an own one only where that is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="impactgraph-"))
    return df.checkpoint()


def check_kinds(kinds: list[str] | tuple[str, ...]) -> None:
    """Unknown edge kinds are an error, never all kinds."""
    unknown = sorted(set(kinds) - set(S.EDGE_KINDS))
    if unknown:
        raise ValueError(f"unknown edge kinds: {', '.join(unknown)}; known: {', '.join(S.EDGE_KINDS)}")


def neighbors(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, direction: str = "both", kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """One hop from seeds (id): seed, neighbor, type, direction, confidence, file_path, test_double."""
    check_kinds(kinds)
    if direction not in ("in", "out", "both"):
        raise ValueError(f"unknown direction: {direction}")
    own = edges.where(F.col("type").isin(*kinds))
    parts = []
    if direction in ("out", "both"):
        parts.append(own.join(seeds.select(F.col("id").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("neighbor"), "type", F.lit("out").alias("direction"), "confidence"))
    if direction in ("in", "both"):
        parts.append(own.join(seeds.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("neighbor"), "type", F.lit("in").alias("direction"), "confidence"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.join(symbols.select(F.col("id").alias("neighbor"), "file_path"), "neighbor").withColumn("test_double", S.is_test_double(F.col("file_path")))


def call_neighbors(edges: DataFrame, symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """Calls both ways, without test doubles."""
    return neighbors(edges, symbols, seeds).where("NOT test_double")


def callers(edges: DataFrame, symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """Calls that come in; test doubles are kept."""
    return neighbors(edges, symbols, seeds, "in")


def capped_groups(found: DataFrame, most: int = 50) -> DataFrame:
    """Neighbours by kind and direction: the true total and the first `most` of each group."""
    by = W.partitionBy("seed", "type", "direction")
    ranked = found.withColumn("total", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("neighbor", F.desc("confidence"))))
    return ranked.where(F.col("rank") <= most)


def file_edges(edges: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """Every edge that touches a file at either end: two equi-joins, not one join with OR."""
    own = symbols.where(F.col("file_path") == path).select("id")
    a = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi")
    b = edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return a.unionByName(b.join(own.withColumnRenamed("id", "src"), "src", "left_anti"))


def dependents(edges: DataFrame, path: str) -> DataFrame:
    """Files that depend on a file, by the `path::name` convention of ids; without itself, sorted."""
    file = F.regexp_replace(F.substring_index("src", "::", 1), "^file:", "")
    return edges.where(F.startswith(F.col("dst"), F.lit(path + "::"))).select(file.alias("file")).where(F.col("file") != path).distinct().orderBy("file")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(id, depth): all that seeds reach, the seeds themselves at depth 0; edges are (src, dst)."""
    step = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")) if reverse else edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    step = cut_lineage(step.distinct())
    seen = cut_lineage(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(step, F.col("id") == F.col("at")).select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(new)
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def cycles(pairs: DataFrame) -> DataFrame:
    """(id, cycle) of all nodes that lie on a cycle of pairs (a, b); a strongly connected set is named by its least node.

    By forward and backward colouring: every node takes the least node that reaches it; what reaches that root within its
    colour is the root's set. Sets and roots go, the rest is coloured again. Rows are as many as the pairs, never all pairs
    that reach each other; rounds follow the length of paths.
    """
    edges = cut_lineage(pairs.select("a", "b").where("a <> b").distinct())
    found = None
    while True:
        into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = cut_lineage(edges.join(into, "a", "left_semi").join(out, "b", "left_semi"))  # ends of paths lie on no cycle
        if edges.isEmpty():
            break
        colour = cut_lineage(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("c", F.col("id")))
        while True:
            sent = edges.join(colour.select(F.col("id").alias("a"), "c"), "a").groupBy(F.col("b").alias("id")).agg(F.min("c").alias("new"))
            step = cut_lineage(colour.join(sent, "id", "left").select("id", F.least("c", F.coalesce("new", "c")).alias("c"), (F.col("new") < F.col("c")).alias("moved")))
            colour = step.select("id", "c")
            if step.where("moved").isEmpty():
                break
        one, two = (colour.select(F.col("id").alias(x), F.col("c").alias("c" + x)) for x in "ab")
        own = edges.join(one, "a").join(two, "b").where("ca = cb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        back = reach(own, colour.where("id = c").select("id"), reverse=True).select("id")
        members = cut_lineage(back.join(colour, "id").select("id", F.col("c").alias("cycle")))
        found = members if found is None else found.unionByName(members)
        edges = edges.join(members.select(F.col("id").alias("a")), "a", "left_anti").join(members.select(F.col("id").alias("b")), "b", "left_anti")
    if found is None:
        return pairs.select(F.col("a").alias("id"), F.col("a").alias("cycle")).limit(0)
    return found.join(found.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1").select("cycle"), "cycle").select("id", "cycle")


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """What depends on seeds, over edges of dependency kinds, to max_depth; seeds are left out."""
    own = edges.where(F.col("type").isin(*S.DEPENDENCY_KINDS))
    return reach(own, seeds, max_depth, reverse=True).where("depth > 0")


def subtypes(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Types and all that extend or implement them, however far."""
    return reach(edges.where(F.col("type").isin("extends", "implements")), types, reverse=True)


def supertypes(edges: DataFrame, types: DataFrame) -> DataFrame:
    return reach(edges.where(F.col("type").isin("extends", "implements")), types)


def change_impact(symbols: DataFrame, edges: DataFrame, type_name: str | None, member: str, params: str | None = None) -> DataFrame:
    """(role, id, file_path, name, start): what must change with `type_name.member`, or with a bare function.

    Declarations are members of the type by that name (and parameter list, if given); supers those of its supertypes;
    family those of other types in the subtype closure of type and supers; callers call any of these; declaring types
    are those that declare them. symbols needs `parent` (id of the declaring type, "" if none) and `params`.
    """
    named = symbols.where((F.col("name") == member) & (F.lit(True) if params is None else F.col("params") == params))
    if type_name is None:
        declared = named.where("parent = ''")
        roles = declared.select("id", F.lit("declaration").alias("role"))
    else:
        own = symbols.where((F.col("name") == type_name) & F.col("kind").isin("class", "struct", "interface", "type", "trait", "protocol")).select("id")
        up = supertypes(edges, own)
        every = subtypes(edges, up.select("id"))
        marked = every.select("id").join(up.withColumnRenamed("depth", "up"), "id", "left")
        role = F.when(F.col("up") == 0, "declaration").when(F.col("up") > 0, "super").otherwise("family")
        roles = named.join(marked.select(F.col("id").alias("parent"), role.alias("role")), "parent").select("id", "role")
    roles = cut_lineage(roles)
    called = edges.where(F.col("type") == "calls").join(roles.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("role", F.lit("caller"))
    types = symbols.join(roles.where("role <> 'super'"), "id", "left_semi").where("parent <> ''").select(F.col("parent").alias("id")).distinct().withColumn("role", F.lit("declaring_type"))
    everything = roles.unionByName(called.join(roles, "id", "left_anti")).unionByName(types)
    return everything.join(symbols.select("id", "file_path", "name", "start"), "id")


def total_sites(found: DataFrame) -> DataFrame:
    """Sites that a change touches; supers are told, not counted."""
    return found.agg(F.coalesce(F.sum((F.col("role") != "super").cast("long")), F.lit(0)).alias("total_sites"))


def completeness(symbols: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """`closed` if every supertype of the declaring types is indexed, else `project-local`."""
    types = found.where("role = 'declaring_type'").select(F.col("id").alias("src"))
    outside = edges.where(F.col("type").isin("extends", "implements")).join(types, "src", "left_semi").join(symbols.select(F.col("id").alias("dst")), "dst", "left_anti")
    return outside.agg(F.when(F.count("*") == 0, "closed").otherwise("project-local").alias("completeness"))


def missing_implementations(symbols: DataFrame, edges: DataFrame, contract: str, member: str) -> DataFrame:
    """(id, status) for every type below a contract: implemented, inherited, unverifiable, abstract_missing or missing.

    A type inherits a member along class extension; a chain that leaves the index can't be judged. `abstract` is a column
    of symbols.
    """
    root = symbols.where((F.col("name") == contract) & F.col("kind").isin("interface", "trait", "protocol", "class")).select("id")
    below = subtypes(edges, root).where("depth > 0").select("id")
    up = edges.where(F.col("type") == "extends").select("src", "dst")
    has = symbols.where(F.col("name") == member).select(F.col("parent").alias("id")).distinct()
    # Types whose own or inherited members hold it: what reaches a holder by extension, seen from the holder downwards.
    inherits = reach(up, has, reverse=True).select("id", (F.col("depth") == 0).alias("own"))
    outside = up.join(symbols.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct()
    loose = reach(up, outside, reverse=True).select("id", F.lit(True).alias("loose"))
    judged = below.join(inherits, "id", "left").join(loose, "id", "left").join(symbols.select("id", "abstract", "file_path", "name"), "id")
    status = F.when(F.col("own"), "implemented").when(F.col("own") == F.lit(False), "inherited").when(F.col("loose"), "unverifiable").when(F.col("abstract"), "abstract_missing").otherwise("missing")
    return judged.select("id", "name", "file_path", status.alias("status"))


def rename_plan(found: DataFrame, lines: DataFrame, symbols: DataFrame, old: str, new: str) -> DataFrame:
    """(file, line, before, after, class): edits for the sites of a change set; lines inside each site's span.

    A site is ambiguous where its span calls the name on an unrelated type too (its symbol's `other_calls` is true), and
    unresolved where the name doesn't occur in its span.
    """
    import re

    if not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", new):
        raise ValueError(f"not an identifier: {new}")
    spans = found.join(symbols.select("id", "end", "other_calls"), "id").where("role <> 'declaring_type'").select("id", "file_path", "start", "end", "other_calls")
    word = rf"\b{re.escape(old)}\b"
    hit = lines.where(F.col("text").rlike(word)).select(F.col("file").alias("file_path"), "line", "text")
    got = spans.join(hit, (spans.file_path == hit.file_path) & F.col("line").between(F.col("start"), F.col("end")), "left").drop(hit.file_path)
    kind = F.when(F.col("line").isNull(), "unresolved").when(F.col("other_calls"), "ambiguous").otherwise("edit")
    return got.select(F.col("file_path").alias("file"), "line", F.col("text").alias("before"), F.regexp_replace("text", word, new).alias("after"), kind.alias("class")).distinct()


def apply_edits(files: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with edits applied, applied and skipped counts). An edit applies only if its line still reads as `before`,
    but for a trailing carriage return, which is kept. Of several edits of one line the first by its texts applies."""
    from impactgraph.sources.adapters import split_lines

    one = edits.groupBy("file", "line").agg(F.min(F.struct("before", "after")).alias("x"), (F.count("*") - 1).alias("more")).select("file", "line", "x.*", "more")
    at = split_lines(files).join(one, ["file", "line"], "left")
    bare = F.regexp_replace("text", "\r$", "")
    good = F.col("before").isNotNull() & (bare == F.col("before"))
    tail = F.when(F.col("text").endswith("\r"), "\r").otherwise("")
    done = at.select("file", "line", F.when(good, F.concat("after", tail)).otherwise(F.col("text")).alias("text"), good.alias("good"))
    whole = done.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))
    hits = one.join(at.select("file", "line", good.alias("good")), ["file", "line"], "left")
    fine = F.coalesce("good", F.lit(False)).cast("long")
    counts = hits.agg(F.coalesce(F.sum(fine), F.lit(0)).alias("applied"), F.coalesce(F.sum(1 - fine + F.col("more")), F.lit(0)).alias("skipped"))
    return whole, counts


def dead_code(symbols: DataFrame, edges: DataFrame, words: DataFrame, extra_roots: DataFrame | None = None) -> DataFrame:
    """(id, status) of functions and methods that no root reaches: dead or exported_unreferenced.

    Roots are main and init, tests, exported symbols and extra ones; dead needs more: not exported, and the name nowhere
    in the text but at its declaration. words: (word, n), occurrences of identifiers.
    """
    code = symbols.where(F.col("kind").isin("function", "method"))
    root = code.where(F.col("name").isin("main", "init") | S.is_view_test(F.col("file_path")) | F.col("exports")).select("id")
    if extra_roots is not None:
        root = root.union(extra_roots.select("id"))
    live = reach(edges.where(F.col("type").isin("calls", "uses-type", "overrides")), root)
    unreached = code.join(live, "id", "left_anti").join(words.select(F.col("word").alias("name"), "n"), "name", "left").where("coalesce(n, 0) <= 1").select("id", F.lit("dead").alias("status"))
    called = edges.select(F.col("dst").alias("id")).distinct()
    loose = code.where("exports").join(called, "id", "left_anti").select("id", F.lit("exported_unreferenced").alias("status"))
    return unreached.unionByName(loose)


def wider_anchors(sizes: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """(seed, id, sites, own): for each seed (id), the symbol of its name with a closed family and the most sites, if that is
    strictly more than its own; the first by pos of equal ones.

    sizes: (id, leaf, sites, closed, test_double, pos). A name that fewer than three symbols share is left out, the seed
    and test doubles among them; the first `most` others that aren't doubles are looked at.
    """
    enough = sizes.groupBy("leaf").agg(F.count("*").alias("n")).where("n >= 3").select("leaf")
    own = sizes.join(seeds.select("id").distinct(), "id", "left_semi").join(enough, "leaf", "left_semi").select(F.col("id").alias("seed"), "leaf", F.col("sites").alias("own"))
    # The seed itself may be among the first, so that one more is kept; a name's list is bounded before it meets its seeds.
    real = sizes.where(~F.col("test_double")).withColumn("rank", F.row_number().over(W.partitionBy("leaf").orderBy("pos", "id"))).where(F.col("rank") <= most + 1)
    pairs = own.join(real, "leaf").where("id <> seed").withColumn("probe", F.row_number().over(W.partitionBy("seed").orderBy("pos", "id"))).where(F.col("probe") <= most)
    wider = pairs.where("closed AND sites > own").withColumn("best", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("sites"), "pos", "id")))
    return wider.where("best = 1").select("seed", "id", "sites", "own")


def wider_anchor(sizes: DataFrame, seed: str, most: int = 8) -> DataFrame:
    """(id, sites, own) of `wider_anchors` for one seed."""
    return wider_anchors(sizes, sizes.where(F.col("id") == seed), most).drop("seed")
