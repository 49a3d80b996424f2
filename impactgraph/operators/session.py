"""What was delivered before: read strategies, deltas, ledgers, pointers and drift, over an ordered log of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S

# Tokens of a file at most, of a graph result from which pointers pay, and confidence bounds.
MAX_FILE_TOKENS, POINTER_TOKENS = 50_000, 600
HIGH, MEDIUM = 0.3, 0.7
# Fixed value: files that a session remembers.
CAPACITY = 50_000


def confidence(since: Column, window: Column) -> Column:
    """How surely something sent `since` tokens ago is still in a context window."""
    ratio = since / window
    return F.when(window <= 0, "low").when(ratio < HIGH, "high").when(ratio < MEDIUM, "medium").otherwise("low")


def distance(ledger: Column, context: Column) -> Column:
    """The larger of two measures of distance; either may be missing."""
    return F.greatest(F.coalesce(ledger, F.lit(0)), F.coalesce(context, F.lit(0)))


def accesses(reads: DataFrame) -> DataFrame:
    """reads: session, file, content_hash, seq (and ts). Adds `count`, reads of the file before, `same`, whether the content
    is that of the last one, and `previous`, that read's tokens.

    A session's reads of one file are ordered together; the log is dealt by session and file.
    """
    by = W.partitionBy("session", "file").orderBy("ts", "seq")
    return reads.withColumns({
        "count": (F.row_number().over(by) - 1).cast("int"), "same": F.coalesce(F.lag("content_hash").over(by) == F.col("content_hash"), F.lit(False)),
        "previous": F.lag("tokens").over(by),
    })


def strategy(count: Column, same: Column, sure: Column, delta: Column) -> Column:
    """How a read is answered: by its number, whether the content is as before, and how surely that is still seen.

    `delta` says that a lossless delta exists and is smaller.
    """
    fresh = F.when((count > 0) & delta, "semantic-delta").otherwise("full-fresh")
    third = F.when(sure == "high", "sha-pointer").when(sure == "medium", "session-signature").otherwise("full-fresh")
    later = F.when(sure == "high", "sha-pointer").otherwise("escalated-full")
    return F.when((count == 0) | ~same, fresh).when(count >= 3, later).when(count == 2, third).otherwise("sha-pointer")


def read_strategies(reads: DataFrame, window: int) -> DataFrame:
    """Every read with its strategy. The distance of a read is all that its session was sent up to it, less the last read of
    the file itself, as the tracker keeps one delivery's tokens and not a running total."""
    log = accesses(reads)
    sent = F.coalesce(F.sum("tokens").over(W.partitionBy("session").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    log = log.withColumn("since", sent - F.coalesce("previous", F.lit(0)))
    sure = confidence(F.col("since"), F.lit(window))
    return log.withColumn("confidence", sure).withColumn("strategy", strategy(F.col("count"), F.col("same"), F.col("confidence"), F.lit(False)))


def capped(strategy: Column, original: Column, delivered: Column) -> tuple[Column, Column]:
    """Strategy and tokens after the safety caps: no more than MAX_FILE_TOKENS, and no partial answer larger than the file."""
    cut = F.least(delivered, F.lit(MAX_FILE_TOKENS))
    back = (original > 0) & (cut > original) & ~strategy.isin("full-fresh", "escalated-full")
    return F.when(back, "full-fresh").otherwise(strategy), F.when(back, original).otherwise(cut)


def recent(reads: DataFrame, n: int = CAPACITY) -> DataFrame:
    """The n files that each session read last."""
    last = reads.groupBy("session", "file").agg(F.max(F.struct("ts", "seq")).alias("last"))
    ranked = last.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy(F.desc("last"))))
    return ranked.where(F.col("rank") <= n).select("session", "file", "rank")


def ledger(calls: DataFrame) -> DataFrame:
    """calls: tool, original, delivered (both null for calls that only count). Per tool, and in a row `total`."""
    n, o, d = F.count("*").alias("calls"), F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("delivered"), F.lit(0)).alias("delivered")
    per = calls.groupBy("tool").agg(n, o, d)
    both = per.unionByName(per.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("delivered"), F.lit(0)).alias("delivered")).withColumn("tool", F.lit("total")))
    return both.withColumn("savings_percent", F.when(F.col("original") == 0, 0.0).otherwise((1 - F.col("delivered") / F.col("original")) * 100))


def symbol_shas(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, key, sha): hash of each symbol's lines. Spans outside the file and keys that occur twice are left out.

    spans: file, key, start, end. Lines meet spans by file, and are put together per span.
    """
    size = lines.groupBy("file").agg(F.max("line").alias("n"))
    good = spans.join(size, "file").where("start >= 1 AND end <= n AND start <= end").drop("n")
    once = good.groupBy("file", "key").agg(F.count("*").alias("times"), F.min("start").alias("start"), F.min("end").alias("end")).where("times = 1").drop("times")
    each = once.select("file", "key", F.explode(F.sequence("start", "end")).alias("line")).join(lines, ["file", "line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return each.groupBy("file", "key").agg(F.sha2(text, 256).alias("sha"))


def semantic_delta(lines: DataFrame, spans: DataFrame, before: DataFrame) -> DataFrame:
    """(file, content, pointers): files with unchanged symbol bodies as one-line pointers, everything else verbatim.

    before: (file, key, sha) of the last delivery. A file is refused, and left out, when a span lies outside it, spans
    overlap, or nothing is unchanged.
    """
    size = lines.groupBy("file").agg(F.max("line").alias("n"))
    placed = spans.join(size, "file")
    by = W.partitionBy("file").orderBy("start", "end")
    bad = placed.withColumn("prev", F.lag("end").over(by)).where("start < 1 OR end > n OR start > end OR prev >= start").select("file").distinct()
    now = symbol_shas(lines, spans)
    same = now.join(before, ["file", "key", "sha"], "left_semi").join(spans, ["file", "key"]).join(bad, "file", "left_anti")
    head = same.select("file", F.col("start").alias("line"), F.concat(F.lit("… ["), F.col("key"), F.lit(" unchanged, sha "), S.short_sha(F.col("sha")), F.lit("] …")).alias("pointer"))
    inner = same.select("file", F.explode(F.sequence("start", "end")).alias("line"), F.lit(True).alias("inside"))
    own = lines.join(same.select("file").distinct(), "file", "left_semi").join(inner, ["file", "line"], "left").join(head, ["file", "line"], "left")
    kept = own.where("inside IS NULL OR pointer IS NOT NULL").select("file", "line", F.coalesce("pointer", "text").alias("text"), F.col("pointer").isNotNull().cast("int").alias("p"))
    return kept.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"), F.sum("p").alias("pointers"))


def delivery_key(tool: str, args: dict) -> str:
    """A session key for a graph result: arguments that don't change it are left out."""
    import json

    own = {k: v for k, v in args.items() if k not in ("context_used", "model", "dir")}
    return f"graph://{tool}?{json.dumps(own, sort_keys=True, separators=(',', ':'))}"


def graph_deliveries(results: DataFrame) -> DataFrame:
    """results: session, key, seq, payload (canonical JSON), confidence. A result as before becomes a pointer, at its second
    delivery or with high confidence; small results never do. Results are computed anew each time."""
    sized = results.withColumn("sha", F.sha2("payload", 256)).withColumn("tokens", S.tokens(F.col("payload")))
    by = W.partitionBy("session", "key").orderBy("seq")
    log = sized.withColumn("seen", F.row_number().over(by)).withColumn("same", F.coalesce(F.lag("sha").over(by) == F.col("sha"), F.lit(False)))
    pointer = F.col("same") & (F.col("tokens") >= POINTER_TOKENS) & ((F.col("seen") == 2) | (F.col("confidence") == "high"))
    return log.withColumn("pointer", pointer)


def file_drift(delivered: DataFrame, current: DataFrame, merges: DataFrame | None = None, most: int = 500) -> DataFrame:
    """(file, status, origin): delivered files, of the most recent ones, that are deleted or changed since.

    delivered: file, content_hash, pos (0 for the latest); current: file, content_hash. Where a merge record names the
    file, the change came by a merge.
    """
    own = delivered.where(F.col("pos") < most).where(~F.startswith("file", F.lit("graph://")))
    got = own.join(current.select("file", F.col("content_hash").alias("now")), "file", "left")
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("content_hash"), "changed")
    out = got.withColumn("status", status).where("status IS NOT NULL").select("file", "status")
    if merges is None:
        return out.withColumn("origin", F.lit("edit"))
    return out.join(merges.select("file").distinct().withColumn("m", F.lit(True)), "file", "left").select("file", "status", F.when(F.col("m"), "merge").otherwise("edit").alias("origin"))


def stale_warning(delivered: DataFrame, current: DataFrame, most: int = 50, preview: int = 5) -> DataFrame:
    """How many of the latest files are stale, and the first of them."""
    stale = file_drift(delivered, current, most=most)
    return stale.agg(F.count("*").alias("stale"), F.slice(F.array_sort(F.collect_list("file")), 1, preview).alias("first"))


def symbol_drift(base: DataFrame, head: DataFrame) -> DataFrame:
    """(file, name, change, signature_changed, body_changed, breaking, renamed_from): a structural diff of snapshots.

    Snapshots: file, name, signature, body. A removed symbol whose body an added one of the file has is a rename; bodies
    that several share rename no one. Removals, renames and changed signatures break callers.
    """
    both = base.select("file", "name", F.col("signature").alias("s0"), F.col("body").alias("b0")).join(head.select("file", "name", F.col("signature").alias("s1"), F.col("body").alias("b1")), ["file", "name"], "full_outer")
    change = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").when((F.col("s0") != F.col("s1")) | (F.col("b0") != F.col("b1")), "changed")
    diff = both.withColumn("change", change).where("change IS NOT NULL")
    gone = diff.where("change = 'removed'").groupBy("file", F.col("b0").alias("body")).agg(F.min("name").alias("old"), F.count("*").alias("n0"))
    new = diff.where("change = 'added'").groupBy("file", F.col("b1").alias("body")).agg(F.min("name").alias("new"), F.count("*").alias("n1"))
    pairs = gone.join(new, ["file", "body"]).where("n0 = 1 AND n1 = 1").select("file", "old", "new")
    out = diff.join(pairs.select("file", F.col("new").alias("name"), F.col("old").alias("renamed_from")), ["file", "name"], "left").join(pairs.select("file", F.col("old").alias("name"), F.lit(True).alias("went")), ["file", "name"], "left").where("went IS NULL")
    change = F.when(F.col("renamed_from").isNotNull(), "renamed").otherwise(F.col("change"))
    signature, body = F.col("change") == "changed", F.col("change") == "changed"
    signature, body = signature & (F.col("s0") != F.col("s1")), body & (F.col("b0") != F.col("b1"))
    return out.select("file", "name", change.alias("change"), F.coalesce(signature, F.lit(False)).alias("signature_changed"), F.coalesce(body, F.lit(False)).alias("body_changed"), (change.isin("removed", "renamed") | F.coalesce(signature, F.lit(False))).alias("breaking"), "renamed_from")


def drift_order(drift: DataFrame) -> DataFrame:
    """Drift of symbols by kind of change, then by name."""
    return drift.orderBy("change", "name", "file")


def sha_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """The same without structure: (file, key, change) from symbol hashes of two states."""
    both = before.select("file", "key", F.col("sha").alias("a")).join(now.select("file", "key", F.col("sha").alias("b")), ["file", "key"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("file", "key", "change")


def index_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """seen, updated, skipped and pruned files between two (file, sha) snapshots."""
    both = before.select("file", F.col("sha").alias("a")).join(now.select("file", F.col("sha").alias("b")), "file", "full_outer")
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("a"), F.col("b")
    return both.agg(flag(b.isNotNull()).alias("files_seen"), flag(b.isNotNull() & ~a.eqNullSafe(b)).alias("files_updated"), flag(b.isNotNull() & a.eqNullSafe(b)).alias("files_skipped"), flag(b.isNull()).alias("files_pruned"))


def compact(turns: DataFrame) -> DataFrame:
    """Conversations with all but their last three turns shortened: conv_id, turn, role, kind, content, original, delivered.

    Explorations become a line of reference, of which a repeat replaces the first with a stub (and only the first: later
    repeats stay); implementations keep 400 characters, others 200. Delivered tokens don't count the stub's saving.
    """
    own = W.partitionBy("conv_id")
    t = turns.withColumn("back", F.row_number().over(own.orderBy(F.desc("turn")))).withColumn("sha", F.sha2("content", 256))
    look = F.col("kind").isin("exploration", "file_read", "search") & (F.col("back") > 3)
    seen = t.withColumn("look", look)
    same = W.partitionBy("conv_id", "look", "sha").orderBy("turn")
    seen = seen.withColumn("nth", F.row_number().over(same)).withColumn("last_kind", F.last("kind").over(same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    times = F.count("*").over(W.partitionBy("conv_id", "look", "sha"))
    ref = F.concat(F.lit("["), F.col("kind"), F.lit("] "), S.summarize(F.col("content"), 120))
    short = F.when(F.col("back") <= 3, F.col("content")).when(F.col("look"), ref).when(F.col("kind").isin("implementation", "edit"), S.summarize(F.col("content"), 400)).otherwise(S.summarize(F.col("content"), 200))
    stub = F.col("look") & (F.col("nth") == 1) & (times > 1)
    out = F.when(stub, F.concat(F.lit("[dedup] previous "), F.col("last_kind"), F.lit(" repeated"))).otherwise(short)
    return seen.select("conv_id", "turn", F.when(stub, "system").otherwise(F.col("role")).alias("role"), "kind", out.alias("content"), S.tokens(F.col("content")).alias("original"), S.tokens(short).alias("delivered"))


def compaction_savings(compacted: DataFrame) -> DataFrame:
    got = compacted.groupBy("conv_id").agg(F.sum("original").alias("original"), F.sum("delivered").alias("delivered"))
    return got.withColumn("savings_percent", F.when(F.col("original") == 0, 0.0).otherwise((1 - F.col("delivered") / F.col("original")) * 100))


# Words that vote for a phase of work, by phase in order of precedence.
PHASES = {
    "debug": ("fix", "bug", "error", "broken", "fails", "failing", "failure", "crash", "exception", "panic", "debug", "diagnose", "investigate", "root cause", "regression", "unexpected", "wrong output"),
    "review": ("review", "audit", "check", "assess", "evaluate", "inspect", "pr", "pull request", "diff", "changes", "refactor"),
    "implement": ("implement", "add", "create", "build", "write", "develop", "introduce", "new feature", "feature", "scaffold", "generate"),
    "explore": ("understand", "explain", "overview", "explore", "summarize", "summary", "describe", "what is", "how does", "tell me", "walk me through", "familiarize", "find out", "discover", "map", "diagram"),
}


def phase(text: Column) -> tuple[dict[str, Column], Column]:
    """Votes of each phase, and the winner; ties go to the first phase of PHASES, no vote is `unknown`."""
    # A plain search stands in front of each pattern, which few words then need.
    low, votes = F.lower(text), {}
    for name, words in PHASES.items():
        total = F.lit(0)
        for w in words:
            total = total + (low.contains(w) & S.contains_word(text, w)).cast("int")
        votes[name] = total
    best = F.greatest(*votes.values())
    out = F.when(best == 0, "unknown")
    for name, v in votes.items():
        out = out.when(v == best, name)
    return votes, out
