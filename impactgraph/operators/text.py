"""Search in lines of text: hits, caps, context, rollups to symbols, term merging, and an identifier index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S

# Caps on hits, in total and per file, plain and exhaustive; on what is shown; on search terms.
MAX_HITS, MAX_PER_FILE = 100, 20
EXHAUSTIVE_HITS, EXHAUSTIVE_PER_FILE = 100_000, 10_000
SHOWN_FILES, SHOWN_PER_FILE = 10, 5
MAX_TERMS = 10

#: Lines of a stretch of a file, by which hits meet spans.
STRETCH = 64


def in_scope(path: Column, scope: list[str] | None) -> Column:
    """Paths at or below those requested. A request of which nothing is valid lets nothing in, never everything."""
    if scope is None:
        return F.lit(True)
    inside = F.lit(False)
    for p in scope:
        p = p.strip("/")
        if p and ".." not in p.split("/"):
            inside = inside | (path == p) | path.startswith(p + "/")
    return inside


def matching(column: Column, term: str, regex: bool = False, whole_word: bool = False) -> Column:
    if not regex and not whole_word:
        return F.lower(column).contains(term.lower())
    return column.rlike(S.pattern(term, regex, whole_word))


def hits(lines: DataFrame, term: str, regex: bool = False, whole_word: bool = False, scope: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """Every matching line: file, line, text."""
    where = matching(F.col("text"), term, regex, whole_word) & in_scope(F.col("file"), scope)
    if glob:
        where = where & S.base_name(F.col("file")).rlike(S.glob_regex(glob))
    return lines.where(where).select("file", "line", "text")


def capped(found: DataFrame, most: int = MAX_HITS, per_file: int = MAX_PER_FILE) -> DataFrame:
    """The first hits in path order, at most per_file of each file and `most` in all: a top-k report."""
    by = W.partitionBy("file").orderBy("line")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_file).drop("rank").orderBy("file", "line").limit(most)


def exhaustive(found: DataFrame) -> DataFrame:
    return capped(found, EXHAUSTIVE_HITS, EXHAUSTIVE_PER_FILE)


def totals(found: DataFrame) -> DataFrame:
    """True totals, to go beside any capped list."""
    return found.agg(F.count("*").alias("total_hits"), F.countDistinct("file").alias("files_matched"))


def with_context(lines: DataFrame, found: DataFrame, n: int = 2) -> DataFrame:
    """Hits with n lines before and after, clamped to the file.

    Only files with hits are looked at; neighbours come by a join on (file, line), so that a file's lines needn't be sorted.
    """
    near = found.select("file", "line", "text", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("step"))
    near = near.where("step <> 0").select("file", "line", "text", "step", (F.col("line") + F.col("step")).alias("other"))
    got = near.join(lines.select("file", F.col("line").alias("other"), F.col("text").alias("near")), ["file", "other"], "left").where("near IS NOT NULL OR step = 1 OR step = -1")
    side = lambda sign: F.transform(F.array_sort(F.collect_list(F.when(sign & F.col("near").isNotNull(), F.struct("step", "near")))), lambda x: x["near"])
    out = got.groupBy("file", "line").agg(F.first("text").alias("text"), side(F.col("step") < 0).alias("before"), side(F.col("step") > 0).alias("after"))
    return out


def innermost(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Each hit with the smallest symbol around it: a range join whose equi-keys are the file and a stretch of STRETCH lines,
    so that a hit meets the spans of its neighbourhood only.

    spans: file, id, start, end. Of equally small spans the first by start, then id, wins.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH).alias("stretch")
    near = spans.where("start <= end").select("file", "id", "start", "end", F.explode(F.sequence(stretch("start"), stretch("end"))).alias("stretch"))
    around = found.select("file", "line", stretch("line")).distinct().join(near, ["file", "stretch"]).where(F.col("line").between(F.col("start"), F.col("end")))
    best = around.groupBy("file", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "start", "id")).alias("best"))
    return found.join(best, ["file", "line"], "left").withColumn("symbol", F.col("best.id")).drop("best")


def rollup(found: DataFrame, spans: DataFrame, files: int = 20, symbols: int = 10) -> DataFrame:
    """Hits by innermost symbol: the `symbols` with most hits; `rest` rows tell what is left out.

    At most `files` files are probed for symbols, those with most hits first; hits elsewhere count as outside.
    """
    per_file = found.groupBy("file").agg(F.count("*").alias("n"))
    probed = per_file.orderBy(F.desc("n"), "file").limit(files).select("file")
    inside = innermost(found.join(F.broadcast(probed), "file", "left_semi"), spans)
    counted = inside.where("symbol IS NOT NULL").groupBy("file", "symbol").agg(F.count("*").alias("hits"))
    # A report of a few rows, so that its order needs no partition of its own.
    top = counted.orderBy(F.desc("hits"), "file", "symbol").limit(symbols)
    shown = top.select("file", "symbol", "hits", F.lit("symbol").alias("row"))
    rest = counted.join(top.select("file", "symbol"), ["file", "symbol"], "left_anti").agg(F.count("*").alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    rest = rest.select(F.lit("").alias("file"), F.concat(F.lit("+"), F.col("n"), F.lit(" more")).alias("symbol"), "hits", F.lit("rest").alias("row"))
    covered = counted.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("c"))
    outside = found.agg(F.count("*").alias("t")).crossJoin(covered).select(F.lit("").alias("file"), F.lit("").alias("symbol"), (F.col("t") - F.col("c")).alias("hits"), F.lit("outside").alias("row"))
    return shown.unionByName(rest).unionByName(outside)


def term_list(spark: SparkSession, terms: list[str]) -> DataFrame:
    """(pos, term): the first MAX_TERMS distinct terms; `terms_left_out` has the others."""
    unique = list(dict.fromkeys(t for t in terms if t))
    return spark.createDataFrame(list(enumerate(unique[:MAX_TERMS])), "pos int, term string")


def terms_left_out(terms: list[str]) -> list[str]:
    """Distinct terms beyond the first MAX_TERMS, to be told beside an answer of `term_list`."""
    return list(dict.fromkeys(t for t in terms if t))[MAX_TERMS:]


def multi(lines: DataFrame, terms: DataFrame, per_term: int = 40) -> DataFrame:
    """Hits of several terms in one scan, grouped by term: the first per_term of each, and the true total.

    Terms are at most MAX_TERMS rows, so that this join is a broadcast of them.
    """
    found = lines.join(F.broadcast(terms), F.contains(F.lower("text"), F.lower("term"))).select("pos", "term", "file", "line", "text")
    total = found.groupBy("term").agg(F.count("*").alias("total"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy("file", "line"))).where(F.col("rank") <= per_term).drop("rank")
    return ranked.join(F.broadcast(total), "term")


def merged(found: DataFrame) -> DataFrame:
    """Hits of all terms, one per file and line: the earliest term's."""
    return found.groupBy("file", "line").agg(F.min(F.struct("pos", "term", "text")).alias("x")).select("file", "line", "x.term", "x.text")


def seeds_from_hits(found: DataFrame, spans: DataFrame, seeds: DataFrame) -> DataFrame:
    """(symbol, class): seeds confirmed by a hit inside them, symbols that hits promote, and hits outside any symbol."""
    placed = innermost(found, spans)
    inside = placed.where("symbol IS NOT NULL").select("symbol").distinct()
    own = seeds.select(F.col("id").alias("symbol")).distinct()
    confirmed = own.join(inside, "symbol", "left_semi").select("symbol", F.lit("confirmed").alias("class"))
    promoted = inside.join(own, "symbol", "left_anti").select("symbol", F.lit("promoted").alias("class"))
    raw = placed.where("symbol IS NULL").select(F.concat_ws(":", "file", "line").alias("symbol"), F.lit("raw").alias("class"))
    return confirmed.unionByName(promoted).unionByName(raw)


def confirmed_first(seeds: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Seeds (id, pos) with confirmed ones in front; the order is otherwise kept."""
    mark = confirmed.select("id").distinct().withColumn("confirmed", F.lit(True))
    return seeds.join(mark, "id", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False))).orderBy(~F.col("confirmed"), "pos")


def shown_hits(found: DataFrame) -> DataFrame:
    """Hits for display: SHOWN_FILES files, SHOWN_PER_FILE of each, with the number that each file has more."""
    by = W.partitionBy("file")
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy("line"))).withColumn("n", F.count("*").over(by))
    first = found.select("file").distinct().orderBy("file").limit(SHOWN_FILES)
    kept = ranked.where(F.col("rank") <= SHOWN_PER_FILE).join(F.broadcast(first), "file", "left_semi")
    return kept.select("file", "line", S.hit_line(F.col("text")).alias("text"), F.greatest(F.col("n") - SHOWN_PER_FILE, F.lit(0)).cast("long").alias("more"))


def cached_lines(found: DataFrame, content_hashes: DataFrame, delivered: DataFrame) -> DataFrame:
    """Hits in files whose present content was delivered already are listed by line number alone."""
    have = content_hashes.join(delivered.select("file", "content_hash").distinct(), ["file", "content_hash"], "left_semi").select("file", F.lit(True).alias("cached"))
    return found.join(have, "file", "left").withColumn("text", F.when(F.col("cached"), F.lit(None)).otherwise(F.col("text"))).drop("cached")


def identifiers(lines: DataFrame) -> DataFrame:
    """(file, line, word): identifiers in code, outside line comments and double-quoted strings."""
    bare = F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"', '""')
    mark = S.comment_prefix(F.col("file"))
    code = F.when(mark == "", bare).otherwise(F.substring_index(bare, "#", 1))
    for m in ("//", "--"):
        code = F.when(mark == m, F.substring_index(bare, m, 1)).otherwise(code)
    return lines.select("file", "line", F.explode(F.split(code, r"[^\p{L}\p{N}_]+")).alias("word")).where("word <> ''")


def references(lines: DataFrame, word: str, definitions: DataFrame) -> DataFrame:
    """(file, count, lines, definitions, ambiguous): code occurrences of a name, by file.

    The line filter comes before the identifiers are split. definitions: (file, line, name).
    """
    own = identifiers(lines.where(F.col("text").contains(word))).where(F.col("word") == word)
    defs = definitions.where(F.col("name") == word)
    n = defs.agg(F.count("*").alias("definitions"))
    grouped = own.groupBy("file").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("line")).alias("lines"))
    return grouped.join(F.broadcast(n)).withColumn("ambiguous", F.col("definitions") > 1)


def noise_note(found: DataFrame, refs: DataFrame, definitions: int) -> DataFrame:
    """A note where text hits far exceed references: `ambiguous`, `noise` or none; ten hits are needed."""
    both = found.agg(F.count("*").alias("hits")).crossJoin(refs.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("refs")))
    note = F.when(F.col("hits") < 10, "").when(F.lit(definitions) > 1, "ambiguous").when((F.col("refs") > 0) & (F.col("refs") * 2 <= F.col("hits")), "noise").otherwise("")
    return both.withColumn("note", note)


def read_range(lines: DataFrame, file: str, offset: int = 1, limit: int | None = None) -> DataFrame:
    """Lines of a file from `offset`, with the file's total on each row; past the end there is one row without text."""
    own = lines.where(F.col("file") == file)
    total = own.agg(F.count("*").alias("total_lines"))
    start = max(1, offset)
    picked = own.where(F.col("line") >= start)
    if limit is not None and limit > 0:
        picked = picked.where(F.col("line") < start + limit)
    return total.join(picked.select("line", "text"), F.lit(True), "left").select("line", "text", "total_lines", (F.col("total_lines") < start).alias("past_end"))
