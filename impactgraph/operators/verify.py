"""Whether a set of changes is complete: what it had to touch, what it missed, and a verdict that fails closed."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S
from impactgraph.operators import sweep

#: Members of a base contract's family whose callers are looked up.
FAMILY_PROBES = 60


def check_ref(ref: str) -> str:
    """A git revision name that can't be read as an option."""
    if ref.startswith("-") or not re.fullmatch(r"[A-Za-z0-9_./^~@{}:-]+", ref):
        raise ValueError(f"not a revision: {ref}")
    return ref


def ranges(diff: DataFrame) -> DataFrame:
    """(file, start, end) on the after side of a zero-context diff. diff: file, line (the diff's own), hunk headers among it.

    A pure deletion marks one line.
    """
    head = diff.where(F.startswith("text", F.lit("@@")))
    start = F.regexp_extract("text", r"\+(\d+)", 1).cast("int")
    count = F.regexp_extract("text", r"\+\d+,(\d+)", 1)
    n = F.when(count == "", 1).otherwise(count.cast("int"))
    return head.select("file", F.greatest(start, F.lit(1)).alias("start"), (F.greatest(start, F.lit(1)) + F.greatest(n, F.lit(1)) - 1).alias("end"))


def touched_spans(spans: DataFrame, changed: DataFrame) -> DataFrame:
    """Spans that a changed range overlaps, by a sweep over each file."""
    return sweep.touched(spans, "start", "end", changed).where("touched").drop("touched")


def seeds(diff: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, file, because, state): changes that others may depend on. diff: as structural drift gives it, with `kind`.

    Functions, methods and constructors are judged; documents and files aren't asked about; other kinds are unverified,
    which keeps the verdict from being complete. Test files are left out.
    """
    own = diff.where(~S.is_verify_test(F.col("file")) & (F.col("change") != "added"))
    kind = F.col("kind")
    state = F.when(kind.isin("function", "method", "constructor"), "seed").when(kind.isin("document", "file"), "ignored").otherwise("unverified")
    because = F.when(F.col("change") == "changed", F.when(F.col("signature_changed"), "signature")).otherwise(F.col("change"))
    return own.withColumn("because", because).where("because IS NOT NULL").select("name", "file", "because", state.alias("state")).where("state <> 'ignored'")


def missed(required: DataFrame, calls: DataFrame, changed: DataFrame) -> DataFrame:
    """(symbol, file, line, detail): required sites that the change doesn't touch.

    required: seed (name), symbol, file, start, end, and seed_file, seed_start where the seed is declared, if known. calls:
    symbol, callee, line. Where a required symbol calls the seed by name, each such line must be touched; where no such call
    is known, its span must be. The seed's own declaration isn't asked about. Two seeds missed at one line are two rows.
    """
    if {"seed_file", "seed_start"} <= set(required.columns):
        required = required.where(~(F.col("file").eqNullSafe(F.col("seed_file")) & F.col("start").eqNullSafe(F.col("seed_start"))))
    hit = F.col("callee").eqNullSafe(F.col("seed")) | F.endswith("callee", F.concat(F.lit("."), F.col("seed")))
    sites = required.join(calls, "symbol").where(hit).select("symbol", "seed", "file", F.col("line"))
    exact = sweep.touched(sites, "line", "line", changed).where("NOT touched").drop("touched").withColumn("detail", F.lit("line"))
    loose = required.join(sites.select("symbol", "seed").distinct(), ["symbol", "seed"], "left_anti")
    span = sweep.touched(loose.select("symbol", "seed", "file", "start", "end"), "start", "end", changed).where("NOT touched").select("symbol", "seed", "file", F.col("start").alias("line"), F.lit("span").alias("detail"))
    per = exact.unionByName(span).groupBy("file", "line", "seed").agg(F.min(F.struct("detail", "symbol")).alias("x"))
    return per.select("x.symbol", "seed", "file", "line", "x.detail")


def ordered_missed(found: DataFrame) -> DataFrame:
    return found.orderBy("file", "line", "seed")


def required_set(impacted: DataFrame, survivors: DataFrame | None = None) -> DataFrame:
    """(seed, seed_file, seed_start, symbol, file, start, end): all that the seeds of a change ask to be touched.

    impacted: those columns and `role` of each seed's change set; supers are told and not asked about, nor are test files.
    survivors: the same columns for members of a removed contract's family that are still there, and their callers.
    """
    names = ["seed", "seed_file", "seed_start", "symbol", "file", "start", "end"]
    asked = ~F.coalesce(S.is_verify_test(F.col("file")), F.lit(False))  # a site without a file is asked about
    own = impacted.where((F.col("role") != "super") & asked).select(*names)
    if survivors is not None:
        own = own.unionByName(survivors.where(asked).select(*names))
    return own.distinct()


def survivors(symbols: DataFrame, edges: DataFrame, seed: DataFrame, most: int = FAMILY_PROBES) -> DataFrame:
    """(seed, symbol, file, start, end): family members of changed contracts that still have the old parameters, and all
    callers of the first `most` members of each seed by file and start: a change of the contract has to touch both.

    seed and symbols as in `base_contract_family`. Of several symbols at one place the one of the least id counts.
    """
    site = ["seed", "file_path", "start"]
    family = base_contract_family(symbols, seed).groupBy(*site).agg(F.min("id").alias("id"))
    by = W.partitionBy("seed").orderBy("file_path", "start")
    probed = family.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    calls = edges.where(F.col("type") == "calls").join(probed.select("seed", F.col("id").alias("dst")), "dst").select("seed", F.col("src").alias("id")).distinct()
    placed = calls.join(symbols.select("id", "file_path", "start"), "id").groupBy(*site).agg(F.min("id").alias("id")).join(family.select(*site), site, "left_anti")
    both = family.select("seed", "id").unionByName(placed.select("seed", "id"))
    return both.join(symbols.select("id", F.col("file_path").alias("file"), "start", "end"), "id").select("seed", F.col("id").alias("symbol"), "file", "start", "end")


def new_dependencies(sites: DataFrame, changed: DataFrame) -> DataFrame:
    """Component pairs all of whose sites lie in touched lines. sites: src_comp, dst_comp, src_file, src_line."""
    return _by_touch(sites, changed).where("every").drop("every", "some")


def introduced_violations(sites: DataFrame, changed: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Violations with a touched site: review where only heuristic evidence stands behind them, else fail."""
    got = _by_touch(sites, changed).where("some").drop("every", "some")
    return got.join(forbidden, ["src_comp", "dst_comp"]).withColumn("level", F.when(F.col("min_tier") == "heuristic", "review").otherwise("fail"))


def _by_touch(sites: DataFrame, changed: DataFrame) -> DataFrame:
    places = sites.groupBy("src_comp", "dst_comp", "src_file", "src_line").agg(F.count("*").alias("n"))
    marked = sweep.touched(places, "src_line", "src_line", changed, "src_file").withColumnRenamed("touched", "hit")
    return marked.groupBy("src_comp", "dst_comp").agg(F.sum("n").alias("weight"), F.bool_and("hit").alias("every"), F.bool_or("hit").alias("some"))


def verdict(changes: DataFrame, missed_sites: DataFrame, unverified: DataFrame, arch: DataFrame) -> DataFrame:
    """clean, incomplete, review or complete, with the counts behind it. Whatever can't be verified is never complete."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    fails = arch.agg(F.coalesce(F.sum((F.col("level") == "fail").cast("long")), F.lit(0)).alias("arch_fail"), F.coalesce(F.sum((F.col("level") == "review").cast("long")), F.lit(0)).alias("arch_review"))
    all_ = one(changes, "changes").crossJoin(one(missed_sites, "missed")).crossJoin(one(unverified, "unverified")).crossJoin(fails)
    out = F.when(F.col("changes") == 0, "clean").when((F.col("missed") > 0) | (F.col("arch_fail") > 0), "incomplete").when((F.col("unverified") > 0) | (F.col("arch_review") > 0), "review").otherwise("complete")
    return all_.withColumn("verdict", out)


def exit_code(verdict: str, strict: bool = False) -> int:
    return 1 if verdict == "incomplete" or (verdict == "review" and strict) else 0


def parameter_list(declaration: str, name: str) -> str | None:
    """The text in the parentheses behind a name, white space collapsed; None if they don't balance."""
    m = re.search(rf"(?<![\w$]){re.escape(name)}\s*(?:<[^()]*>)?\s*\(", declaration)
    if not m:
        return None
    depth, start = 1, m.end()
    for i in range(start, len(declaration)):
        depth += {"(": 1, ")": -1}.get(declaration[i], 0)
        if not depth:
            return " ".join(declaration[start:i].split())
    return None


def parameter_rows(lists: DataFrame) -> DataFrame:
    """lists: params and language. Adds `arity` and, a row for each, `position`, `param` and `type`; no row for an empty list.

    Parameters are split at commas outside brackets. A type is what follows a colon; else a Go parameter without its first
    word, one of a language of the C family without its last, and otherwise the parameter as it is.
    """
    part, opened, closed = F.lit(""), ("<", "(", "["), (">", ")", "]")
    state = F.struct(F.lit(0).alias("depth"), part.alias("part"), F.array().cast("array<string>").alias("done"))

    def step(x, c):
        cut = (c == ",") & (x["depth"] == 0)
        depth = x["depth"] + F.when(c.isin(*opened), 1).when(c.isin(*closed), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(x["part"], c)).alias("part"), F.when(cut, F.array_append(x["done"], x["part"])).otherwise(x["done"]).alias("done"))

    whole = F.aggregate(F.split("params", ""), state, step, lambda x: F.array_append(x["done"], x["part"]))
    split = lists.withColumn("list", F.when(F.trim("params") == "", F.array().cast("array<string>")).otherwise(F.transform(whole, lambda x: F.trim(x))))
    rows = split.withColumn("arity", F.size("list")).select(*lists.columns, "arity", F.posexplode("list").alias("position", "param"))
    words, colon = F.split("param", r"\s+"), F.instr("param", ":")
    n = F.size(words)
    kind = F.when(colon > 0, F.trim(F.expr("substring(param, instr(param, ':') + 1)"))).when((n >= 2) & (F.col("language") == "go"), F.array_join(F.slice(words, 2, n), " "))
    kind = kind.when((n >= 2) & F.col("language").isin("java", "kotlin", "csharp", "cpp", "c"), F.array_join(F.slice(words, 1, n - 1), " ")).otherwise(F.col("param"))
    return rows.withColumn("type", kind)


def parameter_matches(pairs: DataFrame) -> DataFrame:
    """The pairs whose lists are one contract's. pairs: base, params, language, variables (declared type variables of base).

    Lists match when they are equal, or as a relational division: as many parameters on both sides, and at each position
    equal parameters, equal types, or a base parameter that names a declared type variable; where none is declared, one
    capital letter by itself is one. An empty list matches itself alone.
    """
    keys = ["base", "params", "language", "variables"]
    all_ = pairs.select(*keys).distinct()
    base = parameter_rows(all_.select(F.col("base").alias("params"), "language", "variables").distinct())
    word = F.filter(F.split("param", "[^A-Za-z0-9_]+"), lambda x: x != "")
    free = F.when(F.size("variables") > 0, F.arrays_overlap(word, "variables")).otherwise(F.exists(word, lambda x: x.rlike("^[A-Z]$")))
    base = base.select(F.col("params").alias("base"), "language", "variables", F.col("arity").alias("base_arity"), "position", F.col("param").alias("base_param"), F.col("type").alias("base_type"), free.alias("free"))
    other = parameter_rows(all_.select("params", "language").distinct())
    met = all_.join(base, ["base", "language", "variables"]).join(other, ["params", "language", "position"]).where("base_arity = arity AND (free OR param = base_param OR type = base_type)")
    divided = met.groupBy(*keys, "arity").agg(F.count("*").alias("n")).where("n = arity").select(*keys)
    return divided.unionByName(all_.where("base = params")).distinct()


def member_changes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(file, keys, name, p0, p1) of members whose parameter list differs between the two sides of a declaration block.

    Sides: file, keys, line, name, text. Each name's first line counts. Balanced parentheses need Python, on changed lines only.
    """
    @F.pandas_udf("string")
    def parameter_list_udf(declaration: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([parameter_list(d or "", n or "") for d, n in zip(declaration, name, strict=True)], dtype=object)

    own = ["file", *keys, "name"]
    first = lambda d, c: d.groupBy(*own).agg(F.min(F.struct("line", "text")).alias("x")).select(*own, F.col("x.text").alias(c))
    both = first(before, "t0").join(first(after, "t1"), own).where("t0 <> t1")
    p = both.withColumn("p0", parameter_list_udf("t0", "name")).withColumn("p1", parameter_list_udf("t1", "name"))
    return p.where("NOT (p0 <=> p1)").select(*own, "p0", "p1")


#: Kinds of symbols whose bodies are declarations of members.
BLOCKS = ("interface", "type", "trait", "protocol")


#: Lines of a stretch, by which blocks and lines meet.
STRETCH = 64


def block_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, block, line, name, text): lines of declaration blocks (file, block, start, end) that declare a member, white
    space collapsed; a member's name is the first one right before a parenthesis. Comments are left out."""
    # A long block is a row for each STRETCH of its lines, not for each line: few blocks are few tasks.
    stretch = lambda line: F.floor(F.col(line) / STRETCH)
    spans = blocks.where("start <= end").select("file", "block", "start", "end", F.explode(F.sequence(stretch("start"), stretch("end"))).alias("stretch"))
    inside = spans.join(lines.select("file", "line", "text", stretch("line").alias("stretch")), ["file", "stretch"]).where("line BETWEEN start AND end")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    named = inside.select("file", "block", "line", F.regexp_extract(text, r"([A-Za-z_$][\w$]*)\(", 1).alias("name"), text.alias("text"))
    return named.where(~F.col("text").rlike(r"^(//|\*|/\*|#)") & (F.col("name") != ""))


def block_seeds(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """(name, file, block, because, state, params, new_params): what changed declaration blocks (file, block, start0, end0,
    start1, end1 before and after) ask about. before and after: lines of both sides.

    Each member on both sides whose parameters changed is a method seed, with the old list as its contract. A block of which no
    member can be told to have changed is unverified. Test files are left out.
    """
    own = changed.where(~F.coalesce(S.is_verify_test(F.col("file")), F.lit(False)))
    side = lambda lines, i: block_lines(lines, own.select("file", "block", F.col(f"start{i}").alias("start"), F.col(f"end{i}").alias("end")))
    members = member_changes(side(before, 0), side(after, 1), "block").where("coalesce(p0, '') <> ''")
    seeds = members.select("name", "file", "block", F.lit("member").alias("because"), F.lit("seed").alias("state"), F.col("p0").alias("params"), F.coalesce("p1", F.lit("")).alias("new_params"))
    none = own.select("file", "block").join(members, ["file", "block"], "left_anti").select(F.col("block").alias("name"), "file", "block", F.lit("block").alias("because"), F.lit("unverified").alias("state"), F.lit("").alias("params"), F.lit("").alias("new_params"))
    return seeds.unionByName(none)


def removed_with_file(base: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, because, state) of the symbols that deleted files declared; a removed contract is the strongest change.

    base: name, kind, file of the base side's symbols. files: file, state. A deleted file of which no symbol is known is
    unverified by its path, so that no deletion reads as verified.
    """
    gone = files.where("state = 'deleted'").select("file").distinct()
    drift = base.join(gone, "file", "left_semi").select("name", "file", "kind", F.lit("removed with file").alias("change"), F.lit(False).alias("signature_changed"))
    unknown = gone.join(base.select("file"), "file", "left_anti").where(~S.is_verify_test(F.col("file")))
    return seeds(drift, base).unionByName(unknown.select(F.col("file").alias("name"), "file", F.lit("removed with file").alias("because"), F.lit("unverified").alias("state")))


def base_contract_family(symbols: DataFrame, seed: DataFrame) -> DataFrame:
    """(seed, and all columns of symbols): functions, methods and constructors of a changed contract's name whose parameters
    are still those of its base side.

    seed: name and params (the base side's), and, where known, seed (the name, if missing), language, type_parameters,
    new_params (a seed whose parameters didn't change has no family), file_path and start (the seed itself isn't asked
    about). A seed without parameters in its base list has no family. symbols: id, name, kind, params.
    """
    have = set(seed.columns)
    of = lambda name, default: F.coalesce(name, default) if name in have else default
    none = F.array().cast("array<string>")
    wanted = seed.select(
        of("seed", F.col("name")).alias("seed"), "name", F.col("params").alias("base"), of("language", F.lit("")).alias("language"), F.array_sort(of("type_parameters", none)).alias("variables"),
        (F.col("new_params") if "new_params" in have else F.lit(None).cast("string")).alias("now"), (F.col("file_path") if "file_path" in have else F.lit(None).cast("string")).alias("own_file"),
        (F.col("start") if "start" in have else F.lit(None).cast("long")).alias("own_start"),
    ).where("base <> '' AND NOT (base <=> now)")
    own = symbols.where(F.col("kind").isin("function", "method", "constructor")).withColumn("params", F.coalesce("params", F.lit("")))
    pairs = own.join(wanted, "name").where("NOT (file_path <=> own_file AND start <=> own_start)")
    # Lists are compared once for each pair of texts, however many symbols have them.
    keys = ["base", "params", "language", "variables"]
    return pairs.join(parameter_matches(pairs), keys, "left_semi").select("seed", *symbols.columns).distinct()


def nested_scope(lines: list[str], line: int) -> str | None:
    """The header of the innermost function nested around a line, by indentation; None at the outermost level."""
    width = lambda s: len(s[: len(s) - len(s.lstrip(" \t"))].replace("\t", "    "))
    at = line - 1
    if not 0 <= at < len(lines):
        return None
    limit = width(lines[at])
    for i in range(at - 1, -1, -1):
        s = lines[i]
        if not s.strip() or width(s) >= limit:
            continue
        limit = width(s)
        if re.match(r"\s*(?:async\s+)?(?:def|func|function|fn)\b|.*(?:=>|function\s*\()\s*\{?\s*$", s):
            return s.strip() if limit > 0 else None
    return None
