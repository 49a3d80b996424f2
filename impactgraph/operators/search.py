"""Text search over a stored index of character trigrams, and the search of one term in text, symbols or both.

The index holds, for each trigram of lower-cased text, the places where it stands: a document, a stretch of 64 lines, and
the mask of those lines. Postings are written in the order of their trigrams within each task, without a shuffle, so that
a query's filter on a few trigrams skips all other pages of the files. A planner derives trigrams that a match must
have from a literal or a regular expression; the rarest are intersected, as masks, and only the lines that are left are
read and verified by the same condition as a scan's. Terms of under three characters, expressions that ask for no
trigram, and terms with line breaks are scanned.

Null contents are empty. Files of one name are files of their own. An empty index and an unknown term give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.functions import scalars as S
from impactgraph.operators import lookup, text
from impactgraph.sources.adapters import split_lines

#: Lines of a stretch, the bits of a mask; characters that are cut into trigrams at a time.
LINES, SLICE = 64, 1 << 18
#: Trigrams that are intersected, the rarest; documents that are read by their numbers instead of by a join.
RAREST, POINTED = 4, 1000
#: How the tables are packed: postings take most of what a query writes.
CODEC = "zstd"
#: Text hits beside symbols.
BOTH_HITS = 50
_BITS = 21


def codes(grams: list[str]) -> list[int]:
    """Trigrams as whole numbers of three code points."""
    return [ord(g[0]) << 2 * _BITS | ord(g[1]) << _BITS | ord(g[2]) for g in grams]


def _pieces(doc: np.ndarray, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(documents, their first lines, their texts) of about SLICE characters; a long text is cut, with two characters more so
    that no trigram is lost."""
    docs, lines, parts, held = [], [], [], 0
    for d, t in zip(doc.tolist(), texts, strict=True):
        line = 0
        for at in range(0, len(t), SLICE):
            part = t[at : at + SLICE + 2]
            if held and held + len(part) > SLICE:
                yield docs, lines, parts
                docs, lines, parts, held = [], [], [], 0
            docs.append(d)
            lines.append(line)
            parts.append(part)
            held += len(part)
            line += t.count("\n", at, at + SLICE)
    if held:
        yield docs, lines, parts


def postings(docs: list[int], lines: list[int], texts: list[str]) -> tuple[np.ndarray, ...]:
    """(gram, doc, stretch, mask) of texts that start at these lines of their documents; gram, document and stretch once."""
    c = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    gram = c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:]
    end = c == 10
    at = np.cumsum(end)[:-2]
    clean = ~(end[:-2] | end[1:-1] | end[2:])
    gram, at = gram[clean], at[clean]
    # Which document a line of the piece is of, and its number there.
    per = np.array([t.count("\n") + 1 for t in texts])
    owner = np.repeat(np.arange(len(docs)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(lines, per)
    stretch, bit = number // LINES, number % LINES
    new = np.r_[True, (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])]
    unit = np.cumsum(new) - 1
    units, first = int(unit[-1]) + 1, np.flatnonzero(new)
    names, which = np.unique(gram, return_inverse=True)
    key = np.unique((which * units + unit[at]) * LINES + bit[at])
    pair = key // LINES
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    mask = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (key % LINES).astype(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
    place = first[pair[start] % units]
    return names[pair[start] // units], np.asarray(docs, np.int64)[owner[place]], stretch[place], mask.view(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch.column("doc").to_numpy(), batch.column("text").to_pylist()):
            gram, doc, stretch, mask = postings(*piece)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(doc), pa.array(stretch.astype(np.int32)), pa.array(mask)], names=["gram", "doc", "stretch", "mask"])


def _runs(tree) -> list[str]:
    """Strings of plain characters that every match of a parsed expression holds."""
    from re import _constants as K

    out, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is K.LITERAL and 32 <= arg < 127:
            run += chr(arg).lower()
            continue
        if op is K.AT:
            continue
        out.append(run)
        run = ""
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:
            out += _runs(arg[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] >= 1:
            out += _runs(arg[2])
        elif op is K.ATOMIC_GROUP:
            out += _runs(arg)
    return out


def plan(term: str, regex: bool = False, whole_word: bool = False) -> list[list[str]] | None:
    """Sets of trigrams of which a matching line holds all of at least one; None if every line may match."""
    if not regex and not whole_word:
        low = term.lower()
        return [sorted({low[i : i + 3] for i in range(len(low) - 2)})] if len(low) >= 3 and "\n" not in low else None
    try:
        body = term if regex else re.escape(term)
        re.compile(body)
    except re.error:
        body = re.escape(term)
    # Nested and intersected classes and numbers behind a backslash mean something else to Spark's expressions.
    if regex and (re.search(r"\[[^\]]*\[|&&|\\[0-9]", body)):
        return None
    from re import _constants as K
    from re import _parser

    tree = _parser.parse(body)
    if tree.state.flags & re.VERBOSE:
        return None
    while len(tree) == 1 and tree[0][0] is K.SUBPATTERN and not tree[0][1][1] and not tree[0][1][2]:
        tree = tree[0][1][3]
    ways = tree[0][1][1] if len(tree) == 1 and tree[0][0] is K.BRANCH else [tree]
    sets = [sorted({run[i : i + 3] for run in _runs(way) for i in range(len(run) - 2)}) for way in ways]
    return sets if all(sets) else None


class Index:
    """The stored tables `files` (doc, file, content) and `grams` (gram, doc, stretch, mask) below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = spark.read.schema("doc long, file string, content string").parquet(f"{path}/files")
        self.grams = spark.read.schema("gram long, doc long, stretch int, mask long").parquet(f"{path}/grams")

    @classmethod
    def build(cls, files: DataFrame, path: str) -> Index:
        """Write the index of files (file, content); one pass, each task sorts its own postings."""
        spark = files.sparkSession
        files.select(F.monotonically_increasing_id().alias("doc"), "file", F.coalesce("content", F.lit("")).alias("content")).write.option("compression", CODEC).parquet(f"{path}/files")
        stored = spark.read.schema("doc long, file string, content string").parquet(f"{path}/files")
        cut = stored.select("doc", F.lower("content").alias("text")).mapInArrow(_cut, "gram long, doc long, stretch int, mask long")
        cut.sortWithinPartitions("gram", "doc").write.option("compression", CODEC).parquet(f"{path}/grams")
        return cls(spark, path)

    def counts(self, grams: list[str]) -> dict[str, int]:
        """Postings of each of a few trigrams."""
        own = self.grams.where(F.col("gram").isin(codes(grams))).groupBy("gram").count().collect()
        found = {x["gram"]: x["count"] for x in own}
        return {g: found.get(c, 0) for g, c in zip(grams, codes(grams), strict=True)}

    def places(self, term: str, regex: bool = False, whole_word: bool = False) -> DataFrame | None:
        """(doc, stretch, mask) of lines that may match; None if all may."""
        ways = plan(term, regex, whole_word)
        if ways is None:
            return None
        n = self.counts(sorted({g for way in ways for g in way}))
        picked = [sorted(way, key=lambda g: (n[g], g))[:RAREST] for way in ways if all(n[g] for g in way)]
        if not picked:
            return self.grams.select("doc", "stretch", "mask").where(F.lit(False))
        own = self.grams.where(F.col("gram").isin(codes(sorted({g for way in picked for g in way}))))
        # A long text's pieces may tell of one trigram and stretch twice; masks of a trigram are merged, those of several met.
        marks = {g: F.bit_or(F.when(F.col("gram") == c, F.col("mask"))).alias(f"m{c}") for way in picked for g, c in zip(way, codes(way), strict=True)}
        met = own.groupBy("doc", "stretch").agg(*marks.values())
        masks = [F.expr(" & ".join(f"m{c}" for c in codes(way))) for way in picked]
        either = F.coalesce(masks[0], F.lit(0).cast("long"))
        for m in masks[1:]:
            either = either.bitwiseOR(F.coalesce(m, F.lit(0).cast("long")))
        return met.select("doc", "stretch", either.alias("mask")).where("mask <> 0")

    def lines(self, term: str | None = None, regex: bool = False, whole_word: bool = False) -> DataFrame:
        """(file, line, text): all lines, or those that may match a term; every one that does is among them."""
        places = None if term is None else self.places(term, regex, whole_word)
        if places is None:
            return split_lines(self.files)
        near = places.select("doc").distinct()
        few = [x.doc for x in near.limit(POINTED + 1).collect()]
        own = self.files.where(F.col("doc").isin(few)) if len(few) <= POINTED else self.files.join(near, "doc", "left_semi")
        each = own.select("doc", "file", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
        each = each.withColumn("stretch", F.floor(F.col("at") / LINES).cast("int"))
        return each.join(places, ["doc", "stretch"]).where(F.getbit("mask", F.col("at") % LINES) == 1).select("file", (F.col("at") + 1).alias("line"), "text")

    def hits(self, term: str, regex: bool = False, whole_word: bool = False, scope: list[str] | None = None, glob: str | None = None) -> DataFrame:
        """The rows of `text.hits` over all lines."""
        return text.hits(self.lines(term, regex, whole_word), term, regex, whole_word, scope, glob)

    def references(self, word: str, definitions: DataFrame) -> DataFrame:
        """The rows of `text.references` over all lines: code occurrences of a name, by file."""
        return text.references(self.lines(word), word, definitions)


def symbol_files(symbols: DataFrame) -> DataFrame:
    """Symbols as files to be indexed: the id, and what `lookup.search` looks at, a line each."""
    body = F.concat_ws(" ", *[F.col(c) for c in ("signature", "docstring") if c in symbols.columns])
    return symbols.select(F.col("id").alias("file"), F.concat_ws("\n", "name", "qualified_name", body).alias("content"))


def search_symbols(index: Index, symbols: DataFrame, term: str, limit: int = 25) -> DataFrame:
    """The rows of `lookup.search`, of the symbols that the index of `symbol_files` names."""
    places = index.places(term)
    if places is None:
        return lookup.search(symbols, term, limit)
    ids = index.files.join(places.select("doc").distinct(), "doc", "left_semi").select(F.col("file").alias("id")).distinct()
    return lookup.search(symbols.join(ids, "id", "left_semi"), term, limit)


_SHAPE = ("section", "pos", "file", "line", "text", "id", "test_double", "total", "files")


def _section(rows: DataFrame, name: str, **columns: Column) -> DataFrame:
    kinds = {"pos": "long", "file": "string", "line": "long", "text": "string", "id": "string", "test_double": "boolean", "total": "long", "files": "long"}
    return rows.select(F.lit(name).alias("section"), *[(columns[c] if c in columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def search_one(
    index: Index, symbols: DataFrame, symbol_index: Index, term: str, scope: str = "both", limit: int = 25, regex: bool = False, paths: list[str] | None = None, glob: str | None = None, files_only: bool = False, exhaustive: bool = False
) -> DataFrame:
    """One term's answer as rows of sections: symbol, text or file, and total. Symbols go by pos, name and file: exact names,
    prefixes, parts and other text, and test doubles after all real ones.

    scope "text" gives text hits, `limit` at most and 20 of a file, or with files_only the files that these are in;
    "symbols" gives symbols alone; "both" gives symbols and the first 50 text hits, whatever files_only says. An
    exhaustive search has 100,000 hits and 10,000 of a file. The total row, of text scopes, has the true number of hits and
    files beside what is shown. Paths outside the root let nothing in.
    """
    if scope not in ("text", "symbols", "both"):
        raise ValueError(f"unknown scope: {scope}")
    out = []
    if scope != "text":
        found = search_symbols(symbol_index, symbols, term, limit)
        double = S.is_test_double(F.col("file_path"))
        out.append(_section(found, "symbol", pos=F.when(double, 10).otherwise(0) + F.col("rank"), file=F.col("file_path"), line=F.col("start"), text=F.col("name"), id=F.col("id"), test_double=double))
    if scope != "symbols":
        found = index.hits(term, regex, scope=paths, glob=glob)
        shown = text.exhaustive(found) if exhaustive else text.capped(found, limit if scope == "text" else BOTH_HITS)
        if files_only and scope == "text":
            out.append(_section(shown.select("file").distinct(), "file", file=F.col("file")))
        else:
            out.append(_section(shown, "text", file=F.col("file"), line=F.col("line"), text=S.hit_line(F.col("text"))))
        out.append(_section(text.totals(found), "total", total=F.col("total_hits"), files=F.col("files_matched")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select(*_SHAPE)
