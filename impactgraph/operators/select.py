"""Ranked, budgeted context: signals, scores, learned weights, disclosure, the budget fold, and source windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S
from impactgraph.operators import scan

# Weights of graph distance, recency, test relevance and edit frequency in each profile.
PROFILES = {
    "implement_feature": (0.40, 0.20, 0.20, 0.20),
    "fix_bug": (0.2222, 0.2778, 0.2778, 0.2222),
    "code_review": (0.25, 0.1875, 0.25, 0.3125),
    "default": (0.3333, 0.2667, 0.20, 0.20),
}
# Shares of a budget by category, the score cliff, and the score from which bodies are shown.
SHARES = {"dependency": 0.25, "test": 0.20, "doc": 0.10, "summary": 0.10}
CLIFF, RELEVANT = 0.6, 0.15
# Seeds; padding, merge gap, small files, and the share from which a file is shown whole; head of a signature.
SEEDS, PAD, GAP, SMALL_FILE, WHOLE_SHARE, HEAD, MAX_FILES = 5, 2, 4, 80, 0.8, 8, 5
# Learning rate and bounds of learned weights.
RATE, MOST_LEARNED, LEAST_WEIGHT = 0.02, 0.40, 0.05


def touch_stats(touches: DataFrame, now: Column) -> DataFrame:
    """file, last_edit_days, commits_90d over the last 365 days."""
    hours = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
    days = F.greatest(F.floor(hours / 24), F.lit(0)).cast("long")
    recent = touches.withColumn("days", days).where("days <= 365")
    return recent.groupBy("file").agg(F.min("days").alias("last_edit_days"), F.sum((F.col("days") <= 90).cast("long")).alias("commits_90d"))


def signals(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """candidates: file, distance (null if unreachable), tested. Files without changes count as 365 days old."""
    got = candidates.join(stats, "file", "left").fillna({"last_edit_days": 365, "commits_90d": 0})
    return got.withColumns({
        "graph_distance": F.coalesce(1.0 / (1.0 + F.col("distance")), F.lit(0.0)),
        "recency": 1.0 / (1.0 + F.col("last_edit_days") / 30.0),
        "test_relevance": F.coalesce(F.col("tested").cast("double"), F.lit(0.0)),
        "edit_frequency": S.clamp(F.col("commits_90d") / 20.0, 0.0, 1.0),
    })


def score(profile: str = "default", learned: tuple[float, float, float, float] = (0, 0, 0, 0)) -> Column:
    """Weighted sum of the four signals; unknown profiles are the default one, learned changes are clamped."""
    base = PROFILES.get(profile, PROFILES["default"])
    w = [min(1.0, max(LEAST_WEIGHT, b + d)) if any(learned) else b for b, d in zip(base, learned, strict=True)]
    names = ("graph_distance", "recency", "test_relevance", "edit_frequency")
    return F.col(names[0]) * w[0] + F.col(names[1]) * w[1] + F.col(names[2]) * w[2] + F.col(names[3]) * w[3]


def apply_learned(profiles: DataFrame, learned: DataFrame) -> DataFrame:
    """profiles: name and four weights; learned: name and four changes. Profiles without changes stay as they are."""
    names = ("graph_distance", "recency", "test_relevance", "edit_frequency")
    got = profiles.join(learned.select(F.col("name"), *[F.col(n).alias("d_" + n) for n in names]), "name", "left")
    return got.select("name", *[F.when(F.col("d_" + n).isNull(), F.col(n)).otherwise(S.clamp(F.col(n) + F.col("d_" + n), LEAST_WEIGHT, 1.0)).alias(n) for n in names])


def learn(outcomes: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Learned changes by profile from outcomes in order: (name, seq, cited, uncited, missing_tests).

    Each outcome is added and clamped before the next, so that the order counts. Such a step is a function of the shape
    x -> clamp(x + a, l, h), and so are several in a row: outcomes are folded into one by runs of `run` numbers of seq, and
    the runs of a profile then into one. Low ratings bring outcomes without paths, which change nothing.
    """
    steps = outcomes.select("name", "seq", F.floor(F.col("seq") / run).alias("part"), (F.col("cited") * RATE - F.col("uncited") * (RATE * 0.5)).alias("g"), F.when(F.col("missing_tests"), RATE * 2).otherwise(0.0).alias("t"))
    shape = lambda a, low, high: F.struct(a.alias("a"), low.alias("l"), high.alias("h"))
    nothing = shape(F.lit(0.0), F.lit(-1e18), F.lit(1e18))

    def folded(rows: str, then) -> Column:
        def step(x: Column, row: Column) -> Column:
            a, low, high = then(row)
            inside = lambda v: F.greatest(low, F.least(high, v + a))
            return shape(x["a"] + a, inside(x["l"]), inside(x["h"]))

        return F.aggregate(rows, nothing, step)

    most = F.lit(MOST_LEARNED)
    parts = steps.groupBy("name", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "g", "t"))).alias("rows"))
    parts = parts.select("name", "part", *[folded("rows", lambda r, k=k: (r[k], -most, most)).alias(k) for k in "gt"])
    whole = parts.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part", "g", "t"))).alias("rows"))
    whole = whole.select("name", *[folded("rows", lambda r, k=k: (r[k]["a"], r[k]["l"], r[k]["h"])).alias(k) for k in "gt"])
    at = lambda k: F.greatest(F.col(k)["l"], F.least(F.col(k)["h"], F.col(k)["a"]))
    return whole.select("name", at("g").alias("graph_distance"), F.lit(0.0).alias("recency"), at("t").alias("test_relevance"), F.lit(0.0).alias("edit_frequency"))


def feedback_outcomes(feedback: DataFrame) -> DataFrame:
    """Ratings must be 0 to 5; high ones cite one path, low ones none, others say nothing."""
    good = feedback.where(F.col("rating").between(0, 5))
    return good.where("rating >= 4 OR rating <= 1").select(F.lit("default").alias("name"), "seq", (F.col("rating") >= 4).cast("double").alias("cited"), F.lit(0.0).alias("uncited"), F.lit(False).alias("missing_tests"))


def included(candidates: DataFrame, graph: bool = True, docs: bool = False) -> DataFrame:
    """Tests never; documents and dependencies if asked for."""
    out = candidates.where("category <> 'test'")
    if not docs:
        out = out.where("category <> 'doc'")
    return out if graph else out.where("NOT category IN ('target', 'dependency')")


def graph_distance(ranked: DataFrame) -> DataFrame:
    """distance by merged position: seeds 0, one-hop neighbours 1, others 3 and one more for every ten places."""
    return ranked.withColumn("distance", F.when(F.col("seed"), 0).when(F.col("neighbor"), 1).otherwise(3 + F.floor(F.col("pos") / 10)).cast("int"))


def cliff(candidates: DataFrame, *keys: str) -> DataFrame:
    """Candidates up to the first whose score is under CLIFF times the best one; in order of score that is a filter."""
    top = candidates.groupBy(*keys).agg(F.max("score").alias("peak"))
    got = candidates.join(top, list(keys)) if keys else candidates.join(F.broadcast(top))  # without keys it is one row
    return got.where((F.col("peak") <= 0) | (F.col("score") >= F.col("peak") * CLIFF)).drop("peak")


def disclosure() -> Column:
    """The level wanted: needs category, seen, confidence, trivial, score."""
    return (
        F.when(F.col("category") == "doc", "reference")
        .when(F.col("seen") & (F.col("confidence") == "high"), "reference")
        .when(F.col("seen") & (F.col("confidence") == "medium"), "signature")
        .when(F.col("trivial"), "signature")
        .when(F.col("score") >= RELEVANT, "full")
        .otherwise("signature")
    )


def rendered(level: Column) -> Column:
    """A symbol's text at a level."""
    shown = S.display_name(F.col("qualified_name"), F.col("name"))
    plain = (F.col("kind") == "document") | (F.col("language") == "plaintext")
    both = F.concat_ws("\n", "docstring", "signature")
    signature = F.when(plain & (F.col("signature") != ""), F.col("signature")).when(plain & (F.col("docstring") != ""), F.col("docstring")).when((F.col("docstring") != "") & (F.col("signature") != ""), both).when(F.col("signature") != "", F.col("signature")).otherwise(F.col("qualified_name"))
    full = F.when(F.col("raw_text") != "", S.clamp_lines(F.col("raw_text"))).otherwise(F.col("signature"))
    return F.when(level == "full", full).when(level == "signature", signature).otherwise(S.reference(F.col("kind"), shown, F.col("file_path"), F.col("start")))


def select(candidates: DataFrame, budget: int, *keys: str) -> DataFrame:
    """Greedy choice per query: candidates by score get the first level of (wanted, signature, reference) that their
    category still has tokens for; what doesn't fit at all is passed over, not the end.

    candidates: keys, id, score, pos, category, wanted, cost_full, cost_signature, cost_reference. Categories spend their
    own shares, so that each is folded by itself: a list per query and category, after the cliff has cut it.
    """
    near = cliff(candidates, *keys)
    share = F.element_at(F.create_map(*[F.lit(x) for c, s in SHARES.items() for x in (c, int(budget * s))]), F.col("category"))
    listed = near.groupBy(*keys, "category").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "pos", "id", "score", "wanted", "cost_full", "cost_signature", "cost_reference"))).alias("list"))
    start = F.struct(F.coalesce(share, F.lit(0)).cast("long").alias("left"), F.array().cast("array<struct<id:string,score:double,disclosure:string,cost:bigint>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        wanted = F.when(c["wanted"] == "full", c["cost_full"]).when(c["wanted"] == "signature", c["cost_signature"]).otherwise(c["cost_reference"])
        level = F.when(wanted <= a["left"], c["wanted"]).when(c["cost_signature"] <= a["left"], F.lit("signature")).when(c["cost_reference"] <= a["left"], F.lit("reference"))
        cost = F.when(wanted <= a["left"], wanted).when(c["cost_signature"] <= a["left"], c["cost_signature"]).when(c["cost_reference"] <= a["left"], c["cost_reference"]).otherwise(F.lit(0)).cast("long")
        row = F.struct(c["id"].alias("id"), c["score"].alias("score"), level.alias("disclosure"), cost.alias("cost"))
        return F.struct((a["left"] - cost).alias("left"), F.when(level.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"))

    return listed.select(*keys, "category", F.explode(F.aggregate("list", start, step)["out"]).alias("x")).select(*keys, "category", "x.*")


def seeds_free(seeds: DataFrame) -> DataFrame:
    """Seeds stand in full and cost their category nothing."""
    return seeds.where(F.col("pos") < SEEDS).select("id", F.lit(1.0).alias("score"), F.lit("target").alias("category"), F.lit("full").alias("disclosure"), S.tokens(rendered(F.lit("full"))).alias("cost"))


def windows(spans: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """(keys, file, start, end, whole): padded line windows around spans, merged where at most GAP lines lie between.

    spans: keys, file, start, end, full; not-full spans show their head. sizes: file, lines. Small files, and those of which
    the windows cover most, are one window. Islands are found within a file, whose spans are its selected symbols only.
    """
    end = F.greatest("start", "end")
    end = F.when(~F.col("full") & (end - F.col("start") + 1 > HEAD), F.col("start") + HEAD - 1).otherwise(end)
    raw = spans.where("start > 0").select(*keys, "file", "start", end.alias("end")).join(sizes, "file")
    raw = raw.select(*keys, "file", "lines", F.greatest(F.col("start") - PAD, F.lit(1)).alias("start"), F.least(F.col("end") + PAD, "lines").alias("end"))
    by = W.partitionBy(*keys, "file").orderBy("start", "end")
    seen = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col("start") > seen + GAP + 1), 1).otherwise(0)
    island = raw.withColumn("new", new).withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = island.groupBy(*keys, "file", "lines", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    covered = merged.withColumn("covered", F.sum(F.col("end") - F.col("start") + 1).over(W.partitionBy(*keys, "file")))
    whole = (F.col("lines") <= SMALL_FILE) | (F.col("covered") >= F.col("lines") * WHOLE_SHARE)
    out = covered.select(*keys, "file", F.when(whole, F.lit(1)).otherwise(F.col("start")).cast("int").alias("start"), F.when(whole, F.col("lines")).otherwise(F.col("end")).cast("int").alias("end"), whole.alias("whole"))
    return out.distinct()


def file_order(picked: DataFrame, most: int = MAX_FILES, *keys: str) -> DataFrame:
    """(keys, file, best, pos, rank, shown): files by their best score, and whether they are shown or just listed.

    Ranks are counted block by block, so that the files of no answer are one task.
    """
    best = picked.groupBy(*keys, "file").agg(F.max("score").alias("best"), F.min("pos").alias("pos")).withColumn("__all", F.lit(0))
    ranked = scan.prefix(best, [*keys, "__all"], [F.desc("best"), "pos", "file"], pos="rank").drop("__all").withColumn("rank", F.col("rank") + 1)
    return ranked.withColumn("shown", F.col("rank") <= most)


def deliver(sections: DataFrame, budget: int) -> DataFrame:
    """Sections (file, rank, cost) in order until twice the budget is spent; the first is cut rather than left out."""
    hard = 2 * budget
    placed = scan.prefix(sections.withColumn("__all", F.lit(0)), ["__all"], ["rank"], {"before": F.col("cost")}, pos="__at").drop("__all", "__at")
    return placed.withColumn("state", F.when(F.col("before") + F.col("cost") <= hard, "whole").when(F.col("before") == 0, "cut").otherwise("listed"))


def baseline_tokens(picked: DataFrame, sizes: DataFrame, delivered: Column) -> DataFrame:
    """Tokens that reading each picked file once would take, at least what was delivered."""
    total = picked.select("file").distinct().join(sizes.select("file", "bytes"), "file").agg(F.coalesce(F.sum(F.floor(F.col("bytes") / 4)), F.lit(0)).cast("long").alias("t"))
    return total.select(F.greatest("t", delivered).alias("baseline_tokens"))


def anchor_summary(anchors: DataFrame, calls: DataFrame, most: int = 5, shown: int = 3) -> DataFrame:
    """Callers and caller files of the first anchors: (id, callers, files, more)."""
    first = anchors.groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos").limit(most)
    got = first.join(calls.select(F.col("dst").alias("id"), F.col("src"), F.col("src_file")), "id", "left")
    out = got.groupBy("id", "pos").agg(F.count("src").alias("callers"), F.array_sort(F.collect_set("src_file")).alias("all"))
    return out.select("id", "pos", "callers", F.slice("all", 1, shown).alias("files"), F.greatest(F.size("all") - shown, F.lit(0)).alias("more"))
