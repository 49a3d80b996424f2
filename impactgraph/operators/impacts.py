"""Change sets of many seeds at once, by bit-parallel search.

64 seeds are one long: a row is a node, a group of seeds and the mask of those that reached it. A round joins the masks that
are new to the edges, merges them with bit_or, which Spark does before it shuffles, and goes on with the bits that the
target hasn't had. A table of seeds so costs as many rounds as the deepest of them, and a node's row 64 seeds at a time.

Seeds are texts: `Type.member`, `Type.member(Params)`, `pkg.Type.member`, a bare `member`, or `file:line`. A bare name or a
place must mean one function, method or constructor; several are `ambiguous`, none is `unknown`, and neither gives a set. Null and
empty seeds are unknown, repeated ones are one. Ids are unique and never null; null names, parents and parameters match
nothing. Tables without rows give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions.scalars import is_verify_test
from impactgraph.operators.graph import cut_lineage

#: Kinds that a seed can mean, and kinds that declare members.
CALLABLE = ("function", "method", "constructor")
TYPES = ("class", "struct", "interface", "type", "trait", "protocol")
#: Rounds whose masks are merged into one table, so that a long path doesn't read each of its rounds again and again.
MERGED = 8
#: Numbered values, targets of seeds or changed symbols that may be broadcast. Few of them have many rows each, so that a shuffle by
#: them would give a task for each, which grows with the tables.
FEW = 100_000


def numbered(seeds: DataFrame, column: str) -> DataFrame:
    """(column, grp, bit) of its distinct values; numbers are dense within a partition and stay as they are."""
    n = cut_lineage(seeds.select(column).distinct().withColumn("n", F.monotonically_increasing_id()))
    return n.select(column, F.shiftright("n", 6).alias("grp"), F.col("n").bitwiseAND(63).cast("int").alias("bit"))


def _bit() -> Column:
    return F.expr("shiftleft(1L, bit)")


def flood(step: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, grp, mask, depth): the bits that reach id first in that round. step: at, next, distinct and cheap to read again,
    as it is read in each round. start: id, grp, mask.

    Every round has the same plan, so that Spark compiles it once.
    """
    merged = lambda d, *more: d.groupBy("id", "grp").agg(F.bit_or("mask").alias("mask"), *more)
    rounds = [cut_lineage(merged(start).withColumn("depth", F.lit(0)))]
    seen = [rounds[0].drop("depth")]
    while max_depth is None or len(rounds) <= max_depth:
        sent = rounds[-1].join(step, F.col("id") == F.col("at")).select(F.col("next").alias("id"), "grp", "mask", (F.col("depth") + 1).alias("depth"))
        old = merged(reduce(DataFrame.unionByName, seen)).withColumnRenamed("mask", "old")
        new = merged(sent, F.min("depth").alias("depth")).join(old, ["id", "grp"], "left")
        new = cut_lineage(new.select("id", "grp", F.expr("mask & ~coalesce(old, 0L)").alias("mask"), "depth").where("mask <> 0"))
        if new.isEmpty():
            break
        rounds.append(new)
        seen.append(new.drop("depth"))
        if len(seen) > MERGED:
            seen = [cut_lineage(merged(reduce(DataFrame.unionByName, seen)))]
    return reduce(DataFrame.unionByName, rounds)


def beside(table: DataFrame) -> DataFrame:
    """table for a join with many rows of each of its keys: broadcast if it is small, else by shuffle. It should be written."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def unpacked(masks: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row for each bit of masks (grp, mask, ...), with the value that has this number."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("mask", i) == 1)
    return masks.withColumn("bit", F.explode(bits)).drop("mask").join(beside(numbers), ["grp", "bit"]).drop("grp", "bit")


def reach_many(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(seed, id, depth): all that each seed's ids reach, these at depth 0. seeds: seed, id; edges: src, dst."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    numbers = numbered(seeds, "seed")
    start = seeds.join(numbers, "seed").select("id", "grp", _bit().alias("mask"))
    step = cut_lineage(edges.select(F.col(a).alias("at"), F.col(b).alias("next")).distinct())
    return unpacked(flood(step, start, max_depth), numbers).select("seed", "id", "depth")


def parsed(seeds: DataFrame) -> DataFrame:
    """(seed, type_name, member, params, file, line) of distinct texts; what a form doesn't have is null."""
    form, place = r"^(?:([^()]*)\.)?([^.()]+)(?:\((.*)\))?$", r"^(.+):(\d{1,9})$"
    part = lambda at, i: F.nullif(F.regexp_extract("seed", at, i), F.lit(""))
    located, typed = F.col("seed").rlike(place), F.col("seed").rlike(form)
    own = F.when(typed & ~located, part(form, 1))
    return seeds.select(F.coalesce("seed", F.lit("")).alias("seed")).distinct().select(
        "seed", F.regexp_extract(own, r"([^.]*)$", 1).alias("type_name"), F.when(~located, part(form, 2)).alias("member"),
        F.when(~located & F.endswith("seed", F.lit(")")), F.regexp_extract("seed", form, 3)).alias("params"), F.when(located, part(place, 1)).alias("file"), F.when(located, part(place, 2).cast("int")).alias("line"),
    )


def resolved(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, status, id, type_id, member, params), from `parsed`: status is typed, bare, ambiguous or unknown.

    A typed seed has a row for each type of its name; a bare one has the function's id. A place means the innermost symbol
    around it, the first by start and id of equal ones, and of a method that overload alone.
    """
    code = symbols.where(F.col("kind").isin(*CALLABLE)).select("id", "name", "parent", F.coalesce("params", F.lit("")).alias("own"), "file_path", "start", "end")
    types = symbols.where(F.col("kind").isin(*TYPES)).select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    typed = seeds.where("type_name IS NOT NULL").join(types, "type_name", "left").select("seed", F.when(F.col("type_id").isNull(), "unknown").otherwise("typed").alias("status"), F.lit(None).cast("string").alias("id"), "type_id", "member", "params")
    bare = seeds.where("type_name IS NULL AND member IS NOT NULL").join(code, F.col("name") == F.col("member")).where("params IS NULL OR params = own")
    bare = bare.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("id", "parent", "name", "params")).alias("x")).select("seed", "n", "x.*")
    spot = seeds.where("file IS NOT NULL").join(code, (F.col("file_path") == F.col("file")) & F.col("line").between(F.col("start"), F.col("end")))
    spot = spot.groupBy("seed").agg(F.lit(1).cast("long").alias("n"), F.min(F.struct(F.col("end") - F.col("start"), "start", "id", "parent", "name", F.col("own").alias("params"))).alias("x"))
    found = bare.unionByName(spot.select("seed", "n", "x.id", "x.parent", "x.name", "x.params"))
    inside = F.coalesce(F.col("parent") != "", F.lit(False))
    status = F.when(F.col("n") > 1, "ambiguous").when(inside, "typed").otherwise("bare")
    found = found.select("seed", status.alias("status"), F.col("id"), F.when(inside, F.col("parent")).alias("type_id"), F.col("name").alias("member"), "params")
    none = seeds.where("type_name IS NULL").join(found, "seed", "left_anti").select("seed", F.lit("unknown").alias("status"), *(F.lit(None).cast("string").alias(c) for c in ("id", "type_id", "member", "params")))
    return typed.unionByName(found).unionByName(none)


def impacts(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, callers_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """((seed, role, id), (seed, status, completeness)) of all seeds (seed, a text) in one run.

    Roles are those of `graph.change_impact`: declaration, super, family, caller, declaring_type; a symbol has one role, but
    that a type that declares members is told beside. Declarations are the members of the seed's types by name (and
    parameters, if given), supers those of their supertypes, family those of the other types below type and supertypes.
    Status is resolved, ambiguous or unknown; completeness is `closed` if all supertypes of the declaring types are indexed,
    `project-local` if not, and null without a set. With callers_only, an ambiguous name gives the callers of all that
    bear it, and its completeness is `callers-only`.
    """
    targets = cut_lineage(resolved(symbols, parsed(seeds)))
    up = cut_lineage(edges.where(F.col("type").isin("extends", "implements")).select("src", "dst").distinct())
    typed = targets.where("status = 'typed'")
    numbers = numbered(typed.select("type_id"), "type_id")
    start = numbers.select(F.col("type_id").alias("id"), "grp", _bit().alias("mask"))
    above = flood(up.select(F.col("src").alias("at"), F.col("dst").alias("next")), start)
    every = flood(up.select(F.col("dst").alias("at"), F.col("src").alias("next")), above.drop("depth"))
    ored = lambda condition, name: F.bit_or(F.when(condition, F.col("mask")).otherwise(F.lit(0).cast("long"))).alias(name)
    closure = every.withColumn("depth", F.lit(None).cast("int")).unionByName(above).groupBy("id", "grp").agg(F.bit_or("mask").alias("mask"), ored(F.col("depth") == 0, "own"), ored(F.col("depth") > 0, "above"))
    # What the seeds of a group ask of a name: one row a name, parameter list and group, whatever the number of seeds.
    wanted = typed.join(numbers, "type_id").groupBy("member", "params", "grp").agg(F.bit_or(_bit()).alias("want"))
    members = symbols.where("parent <> ''").select("id", "parent", F.col("name").alias("member"), F.coalesce("params", F.lit("")).alias("has"))
    hit = members.join(closure.withColumnRenamed("id", "parent"), "parent").join(wanted, ["member", "grp"]).where("(params IS NULL OR params = has) AND mask & want <> 0")
    hit = hit.withColumn("mask", F.expr("mask & want"))
    parts = F.array(*[F.struct(F.lit(role).alias("role"), F.expr(rule).alias("mask")) for role, rule in (("declaration", "mask & own"), ("super", "mask & above & ~own"), ("family", "mask & ~own & ~above"))])
    rows = unpacked(hit.select("id", "member", "params", "grp", F.inline(parts)).where("mask <> 0"), numbers)
    same = (F.col("t.type_id") == F.col("r.type_id")) & (F.col("t.member") == F.col("r.member")) & F.col("t.params").eqNullSafe(F.col("r.params"))
    roles = rows.alias("r").join(beside(typed).alias("t"), same).select("t.seed", "r.role", "r.id").unionByName(targets.where("status = 'bare'").select("seed", F.lit("declaration").alias("role"), "id"))
    # A seed whose name several types bear may meet a member in two roles: the nearer one holds.
    rank = F.when(F.col("role") == "declaration", 0).when(F.col("role") == "super", 1).otherwise(2)
    roles = cut_lineage(roles.groupBy("seed", "id").agg(F.min_by("role", rank).alias("role")))
    asked = roles.select("seed", "id", F.lit(True).alias("known"))
    if callers_only:
        loose = targets.where("status = 'ambiguous'").select("seed", F.col("member").alias("name"), "params")
        bearing = symbols.where(F.col("kind").isin(*CALLABLE)).select("id", "name", F.coalesce("params", F.lit("")).alias("has")).join(loose, "name").where("params IS NULL OR params = has")
        asked = asked.unionByName(bearing.select("seed", "id", F.lit(False).alias("known")))
    everyone = numbered(asked, "seed")
    masks = asked.join(beside(everyone), "seed").groupBy("id", "grp").agg(F.bit_or(_bit()).alias("mask"), F.bit_or(F.when(F.col("known"), _bit()).otherwise(F.lit(0).cast("long"))).alias("known"))
    calls = edges.where(F.col("type") == "calls").select("src", "dst").distinct()
    called = calls.join(masks.select(F.col("id").alias("dst"), "grp", "mask").hint("merge"), "dst").groupBy(F.col("src").alias("id"), "grp").agg(F.bit_or("mask").alias("mask"))
    called = called.join(masks.select("id", "grp", "known").hint("merge"), ["id", "grp"], "left").withColumn("mask", F.expr("mask & ~coalesce(known, 0L)")).where("mask <> 0").select("id", "grp", "mask")
    # Unknown callers go while a row is 64 seeds.
    known = symbols.select("id")
    called = called.join(known, "id", "left_semi")
    callers = unpacked(called, everyone).select("seed", F.lit("caller").alias("role"), "id")
    declaring = roles.where("role <> 'super'").join(symbols.select("id", "parent"), "id").where("parent <> ''").select("seed", F.lit("declaring_type").alias("role"), F.col("parent").alias("id")).distinct()
    declaring = declaring.join(known, "id", "left_semi").select("seed", "role", "id")
    found = roles.select("seed", "role", "id").unionByName(callers.select("seed", "role", "id")).unionByName(declaring)
    outside = up.join(symbols.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True))
    open_ = declaring.join(outside, "id", "left").groupBy("seed").agg(F.max(F.coalesce("out", F.lit(False))).alias("out"))
    declared = roles.select("seed").distinct().withColumn("set", F.lit(True))
    told = targets.groupBy("seed").agg(F.max(F.col("status") == "ambiguous").alias("several")).join(declared, "seed", "left").join(open_, "seed", "left")
    status = F.when(F.col("set"), "resolved").when(F.col("several"), "ambiguous").otherwise("unknown")
    complete = F.when(F.col("set"), F.when(F.col("out"), "project-local").otherwise("closed")).when(F.col("several") & F.lit(callers_only), "callers-only")
    return found, told.select("seed", status.alias("status"), complete.alias("completeness"))


def required_many(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((seed, seed_file, seed_start, symbol, file, start, end), (id, name, reason)): all that a table of changed symbols asks to
    be touched, and the changed symbols that nothing can be said of, which keep a verdict from being complete.

    changed: id, name, qualified_name, parent_name (of the declaring type), file_path, start. Each is tried by its qualified
    name if that has a dot, by parent and name, by name, and at last by the callers of all of its name; the first try
    that finds declarations holds. Family, callers and declaring types count, but not in test files; a site without a file counts.
    """
    named = F.coalesce("name", F.lit(""))
    tries = F.array(F.when(F.contains("qualified_name", F.lit(".")), F.col("qualified_name")), F.when(F.coalesce("parent_name", F.lit("")) != "", F.concat("parent_name", F.lit("."), named)), named)
    each = changed.select(F.col("id").alias("changed"), F.posexplode(tries).alias("nth", "seed")).where("seed IS NOT NULL")
    found, states = impacts(symbols, edges, each.select("seed"), callers_only=True)
    good = each.join(states.where("completeness IS NOT NULL"), "seed")
    first = good.withColumn("rank", F.row_number().over(W.partitionBy("changed").orderBy((F.col("status") != "resolved").cast("int"), "nth"))).where("rank = 1").select("changed", "seed")
    own = changed.select(F.col("id").alias("changed"), F.col("name").alias("seed_name"), F.col("file_path").alias("seed_file"), F.col("start").alias("seed_start"))
    first = cut_lineage(first.join(own, "changed"))
    sites = found.where("role IN ('family', 'caller', 'declaring_type')").join(beside(first), "seed").drop("seed").join(symbols.select("id", F.col("file_path").alias("file"), "start", "end"), "id")
    required = sites.where(~F.coalesce(is_verify_test(F.col("file")), F.lit(False))).select(F.col("seed_name").alias("seed"), "seed_file", "seed_start", F.col("id").alias("symbol"), "file", "start", "end").distinct()
    empty = changed.join(sites.select(F.col("changed").alias("id")), "id", "left_anti").join(first.select(F.col("changed").alias("id"), F.lit(True).alias("met")), "id", "left")
    reason = F.when(F.col("met"), "no dependents").otherwise("no declaration")
    return required, empty.select("id", "name", reason.alias("reason"))
