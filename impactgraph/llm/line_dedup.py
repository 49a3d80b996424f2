"""Line deduplication within an edit bound, by a deletion-neighbourhood join in DataFrame operations alone.

A unit is a line, however long; words are what single spaces part. A unit is removed when an earlier unit of the corpus
(smaller doc_id, then earlier in its text) lies within the edit bound: one word inserted, deleted or replaced for each EACH
words of the shorter unit, and BOUND in all. With BOUND 1 the variants of a unit are itself and itself without one word.
The earlier unit counts whether or not it is removed itself. Units of white space only always stay.

Units are left out first that share neither half with another unit, which edits of one word always leave: one half of the
words is intact. Each other unit emits as hashed keys itself and its variants, without each of the words outside the half
that it shares; units that share a key are within the bound, by the key's kind: a replaced word leaves equal variants at one
place, an inserted word makes a variant of the longer unit equal to the shorter one. So a key needs only its earliest units,
never its pairs. The edit distance is verified on the words themselves. Variants of BLOCK words or more are hashed by
polynomials modulo two primes, whose sums up to each word give all variants in time proportional to the words; shorter ones
directly. That is a matter of time: either way a variant has one key, and equal variants have equal ones.

Joins of all units, keys or texts have one kind at any size, so that what they shuffle grows with the input alone.

Null texts stay null and have no units. A null doc_id ranks last. Rows with equal ids follow each other in a fixed order.
A unit goes with its line break; a document may become empty, and stays as a row. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactgraph.llm.common import Scratch, few, numbered

#: Edits allowed at most, and the words of a unit for each.
BOUND, EACH = 1, 8
#: Words whose sums are appended to one list; variants of as many words are hashed by sums.
BLOCK = 256
#: Single numbers that may be broadcast as keys: 8 MB.
KEYS = 1_000_000

#: Primes and bases of the hashes of long sequences; products stay below 2^63.
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 1664525)


def units(docs: DataFrame) -> DataFrame:
    """row_key, rank, u, unit: all units that aren't blank, u being the line's number."""
    lines = docs.select("row_key", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rank"), F.posexplode(F.split("text", "\n", -1)).alias("u", "unit"))
    return lines.where(F.col("unit").rlike(r"[^\x20\x09-\x0D]"))


def _pos() -> Column:
    return F.struct("rank", "row_key", "u")


def _halves(words: Column) -> Column:
    """Hashes of the parts that stay intact when a word is edited, by the places of `_open`: of n words the first n // 2,
    the n // 2 - 1 first (n even) or (n + 1) // 2 last (n odd), and the n // 2 last."""
    n = F.size(words)
    low, high = F.shiftright(n, 1), F.shiftright(n + 1, 1)
    head = lambda m: F.xxhash64(F.lit("head"), F.slice(words, 1, m))
    tail = lambda m: F.xxhash64(F.lit("tail"), F.slice(words, n - m + 1, m))
    return F.array(head(low), F.when(low == high, head(low - 1)).otherwise(tail(high)), tail(low))


def _open(k: Column, n: Column) -> list[Column]:
    """lo, hi: the words outside part k of `_halves`, where units that share it may differ."""
    low, even = F.shiftright(n, 1), n % 2 == 0
    lo = F.when(k == 0, low + 1).when((k == 1) & even, low).otherwise(1)
    hi = F.when((k == 0) | ((k == 1) & even), n).when(k == 1, low).otherwise(n - low)
    return [lo.alias("lo"), hi.alias("hi")]


def _sums(words: Column) -> Column:
    """For each word, Σ hash(word j) * base^j up to it, by both primes as struct (s0, s1).

    Lists are appended to within blocks of BLOCK words only, as every append copies.
    """
    long = lambda x: F.lit(x).cast("long")
    hashed = lambda w, t: F.pmod(F.xxhash64(w), long(_PRIMES[t]))
    none = F.array().cast("array<struct<s0:bigint,s1:bigint>>")

    def step(a: Column, w: Column) -> Column:
        p = [F.pmod(a[f"p{t}"] * long(_BASES[t]), long(_PRIMES[t])) for t in (0, 1)]
        s = [F.pmod(a[f"s{t}"] + hashed(w, t) * p[t], long(_PRIMES[t])) for t in (0, 1)]
        out = F.concat(a["out"], F.array(F.struct(s[0].alias("s0"), s[1].alias("s1"))))
        return F.struct(p[0].alias("p0"), p[1].alias("p1"), s[0].alias("s0"), s[1].alias("s1"), out.alias("out"))

    def state(a: Column | None, out: Column) -> Column:
        return F.struct(*((long(int(k[0] == "p")) if a is None else a[k]).alias(k) for k in ("p0", "p1", "s0", "s1")), out.alias("out"))

    def block(a: Column, ws: Column) -> Column:
        return F.aggregate(ws, state(a, none), step, lambda b: state(b, F.concat(a["out"], F.array(b["out"]))))

    starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(words, b * BLOCK + 1, BLOCK))
    nothing = F.array().cast("array<array<struct<s0:bigint,s1:bigint>>>")
    return F.flatten(F.aggregate(blocks, state(None, nothing), block, lambda a: a["out"]))


def _long_keys(words: Column, variants: bool) -> Column:
    """Hashes of the words, then (variants) of the words without word 1, 2, ..."""
    whole = lambda sums: F.array(F.xxhash64(F.element_at(sums, -1)))
    if not variants:
        return F.transform(F.array(_sums(words)), lambda sums: whole(sums)[0])
    back = [pow(b, -1, p) for b, p in zip(_BASES, _PRIMES, strict=True)]

    def keys(sums: Column) -> Column:
        end = F.element_at(sums, -1)

        def without(at: Column, i: Column) -> Column:
            before = [F.when(i > 0, F.get(sums, i - 1)[f"s{t}"]).otherwise(F.lit(0).cast("long")) for t in (0, 1)]
            rest = [F.pmod(end[f"s{t}"] - at[f"s{t}"], F.lit(_PRIMES[t]).cast("long")) for t in (0, 1)]
            return F.xxhash64(F.struct(*(F.pmod(before[t] + rest[t] * F.lit(back[t]).cast("long"), F.lit(_PRIMES[t]).cast("long")).alias(f"s{t}") for t in (0, 1))))

        return F.concat(whole(sums), F.transform(sums, without))

    # Through arrays of one, so that the sums are worked out once a unit.
    return F.flatten(F.transform(F.array(_sums(words)), keys))


def _keys(near: DataFrame) -> DataFrame:
    """x, n, i, key: the unit itself (i 0), and the unit without word i for the words from lo to hi.

    Such a key meets others at its place, as a replaced word, and the whole of shorter units.
    """
    words, n, i = F.col("words"), F.size("words"), F.col("i")
    # A sequence of BLOCK words is what a longer unit may become by a deletion, so it has their kind of hash.
    sums = F.when(n == BLOCK, _long_keys(words, False)).when(n > BLOCK, _long_keys(words, True))
    # Units become rows of numbers first, so that Spark compiles the hashes of the many shorter ones.
    rows = near.select("x", "words", sums.alias("sums"), F.concat(F.array(F.lit(0)), F.sequence("lo", "hi")).alias("places")).select("x", "words", "sums", F.explode("places").alias("i"))
    without = F.xxhash64(F.slice(words, 1, i - 1), F.slice(words, i + 1, n))
    direct = F.when(i == 0, F.xxhash64(words)).otherwise(without)
    return rows.select("x", n.alias("n"), "i", F.coalesce(F.get("sums", i), direct).alias("key"))


def removed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_key, u) of every unit that goes. docs: row_key, doc_id, text."""
    all_ = units(docs).withColumn("words", F.split("unit", " ", -1)).withColumn("n", F.size("words"))
    slim = all_.select("row_key", "rank", "u", F.xxhash64("unit").alias("k1"), F.xxhash64(F.lit(1), "unit").alias("k2"), "n", F.when(F.col("n") >= EACH, _halves(F.col("words"))).alias("halves"))
    slim = scratch.write(slim, "units")
    # Equal units have equal halves, so that any one's will do.
    first = slim.groupBy("k1", "k2").agg(F.min(_pos()).alias("first"), F.count("*").alias("times"), F.any_value(F.struct("n", "halves")).alias("any"))
    first = scratch.write(first.select("k1", "k2", "times", "first.*", "any.*"), "first")
    repeated = first.where("times > 1").select("k1", "k2", _pos().alias("first"))
    copies = slim.join(repeated.hint("merge"), ["k1", "k2"]).where(_pos() > F.col("first")).select("row_key", "u")
    copies = scratch.write(copies, "copies")
    scratch.drop("units")

    # Of each distinct unit that may have an edit the first place; those that share a half with another, numbered in the
    # order of their places, and the words where they may differ.
    half = first.where("halves IS NOT NULL").select("rank", "row_key", "u", "n", F.posexplode("halves").alias("k", "h"))
    met = scratch.write(half.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "met")
    sharing = half.join(F.broadcast(met) if few(met, KEYS) else met, "h").select("rank", "row_key", "u", *_open(F.col("k"), F.col("n")))
    open_ = scratch.write(sharing.groupBy("rank", "row_key", "u").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "open")
    open_ = open_.orderBy("rank", "row_key", "u").select("row_key", "u", F.monotonically_increasing_id().alias("x"), "lo", "hi")
    open_ = scratch.write(open_, "ordered")
    scratch.drop("first", "met", "open")
    names = scratch.write(open_.select("row_key").distinct(), "names")
    own = docs.join(F.broadcast(names) if few(names, KEYS) else names, "row_key", "left_semi")
    # Five numbers a row: some 40 MB at most.
    near = units(own).join(F.broadcast(open_) if few(open_) else open_, ["row_key", "u"])
    near = scratch.write(near.select("x", "row_key", "u", "lo", "hi", F.split("unit", " ", -1).alias("words")), "near")

    keys = scratch.write(_keys(near), "keys")
    # What is hashed in these joins has a key once: swap as it is grouped, whole units as each is there once.
    edits = keys.where("i > 0")
    swap = edits.groupBy("n", "i", "key").agg(F.min("x").alias("y"), F.max("x").alias("most")).where("y < most").select("n", "i", "key", "y")
    swap = scratch.write(swap, "swap")
    swapped = edits.join(swap.hint("shuffle_hash"), ["n", "i", "key"]).where("x > y").select("x", "i", "y", F.lit("swap").alias("kind"))
    whole = keys.where("i = 0").select("n", "key", F.col("x").alias("short"))
    meet = edits.select((F.col("n") - 1).alias("n"), "key", "i", F.col("x").alias("long")).join(whole.hint("shuffle_hash"), ["n", "key"]).select("short", "long", "i")
    meet = scratch.write(meet, "meet")
    longer = meet.where("long > short").select(F.col("long").alias("x"), "i", F.col("short").alias("y"), F.lit("drop").alias("kind"))
    shorter = meet.where("short > long").groupBy("short").agg(F.min("long").alias("y"), F.min_by("i", "long").alias("i")).select(F.col("short").alias("x"), "i", "y", F.lit("add").alias("kind"))
    found = scratch.write(swapped.unionByName(longer).unionByName(shorter).distinct(), "found")
    scratch.drop("keys")

    a, b = near.select("x", "row_key", "u", F.col("words").alias("a")), near.select(F.col("x").alias("y"), F.col("words").alias("b"))
    before = lambda w: F.slice(w, 1, F.col("i") - 1)
    behind = lambda w, k: F.slice(w, F.col("i") + k, F.size(w))
    left = F.when(F.col("kind") == "add", 0).otherwise(1)
    right = F.when(F.col("kind") == "drop", 0).otherwise(1)
    true = (before("a") == before("b")) & (behind("a", left) == behind("b", right))
    edited = found.join(a.hint("merge"), "x").join(b.hint("merge"), "y").where(true).select("row_key", "u").distinct()
    return scratch.write(copies.unionByName(edited), "gone")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the units that go), n_units (lines of the text, blank ones included), n_removed."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    none = F.lit(0).cast("long")
    nulls = docs.where("text IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), none.alias("n_units"), none.alias("n_removed"))
    rows = numbered(docs, scratch)
    docs = rows.where("doc.text IS NOT NULL").select("row_key", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    gone = scratch.write(removed(docs, scratch).groupBy("row_key").agg(F.array_sort(F.collect_list("u")).alias("gone")), "per-row")
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda line, u: F.when(~F.array_contains("gone", u), line)), lambda x: x.isNotNull())
    # All texts are shuffled once, at any size, and not sorted: what goes is the side that is hashed.
    all_ = docs.join(gone.hint("shuffle_hash"), "row_key", "left")
    whole = F.col("gone").isNull()
    all_ = all_.select("doc_id", F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.size(lines).cast("long").alias("n_units"), F.when(whole, none).otherwise(F.size("gone").cast("long")).alias("n_removed"))
    return all_.unionByName(nulls)
