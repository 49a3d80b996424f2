from pyspark.sql import functions as F

from impactgraph.operators import text
from impactgraph.sources.adapters import blocks, split_lines


def tree(spark):
    return split_lines(spark.createDataFrame([("a.go", "package a\nfunc Needle() {}\n\n// needle again"), ("sub/b.txt", "NEEDLE here\nnothing"), ("sub/c.md", "none")], "file string, content string"))


def places(df):
    return sorted((r.file, r.line) for r in df.collect())


def test_hits_and_scope(spark):
    lines = tree(spark)
    assert places(text.hits(lines, "needle")) == [("a.go", 2), ("a.go", 4), ("sub/b.txt", 1)]
    assert places(text.hits(lines, "needle", scope=["sub"])) == [("sub/b.txt", 1)]
    assert places(text.hits(lines, "needle", scope=["../etc"])) == []
    assert places(text.hits(lines, "needle", glob="*.txt")) == [("sub/b.txt", 1)]
    assert places(text.hits(lines, "need", whole_word=True)) == []
    assert tuple(text.totals(text.hits(lines, "needle")).first()) == (3, 2)


def test_caps(spark):
    lines = split_lines(spark.createDataFrame([("a", "\n".join(["x"] * 9)), ("b", "\n".join(["x"] * 9))], "file string, content string"))
    hits = text.hits(lines, "x")
    assert places(text.capped(hits, 5, 3)) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert text.exhaustive(hits).count() == 18
    shown = text.shown_hits(hits).collect()
    assert len(shown) == 10 and {r.more for r in shown} == {4}


def test_context(spark):
    lines = tree(spark)
    got = {(r.file, r.line): (r.before, r.after) for r in text.with_context(lines, text.hits(lines, "needle")).collect()}
    assert got[("a.go", 2)] == (["package a"], ["", "// needle again"])
    assert got[("sub/b.txt", 1)] == ([], ["nothing"])
    one = split_lines(spark.createDataFrame([("q", "x")], "file string, content string"))
    assert [(r.before, r.after) for r in text.with_context(one, text.hits(one, "x")).collect()] == [([], [])]


def test_innermost_and_rollup(spark):
    lines = split_lines(spark.createDataFrame([("a", "\n".join(["x"] * 20)), ("b", "y")], "file string, content string"))
    spans = blocks(lines)
    got = {(r.file, r.line): r.symbol for r in text.innermost(text.hits(lines, "x"), spans).collect()}
    assert got[("a", 1)] == "a::b1" and got[("a", 9)] == "a::b9" and got[("a", 20)] == "a::b17"
    rows = {(r.symbol, r.row): r.hits for r in text.rollup(text.hits(lines, "x"), spans, symbols=2).collect()}
    assert rows == {("a::b1", "symbol"): 8, ("a::b9", "symbol"): 8, ("+1 more", "rest"): 4, ("", "outside"): 0}


def test_terms(spark):
    lines = tree(spark)
    terms = text.term_list(spark, ["needle", "here", "needle", ""] + [f"t{i}" for i in range(20)])
    assert terms.count() == text.MAX_TERMS
    got = text.multi(lines, terms, per_term=2)
    assert sorted((r.term, r.file, r.line, r.total) for r in got.collect()) == [("here", "sub/b.txt", 1, 1), ("needle", "a.go", 2, 3), ("needle", "a.go", 4, 3)]
    found = lines.join(F.broadcast(terms), F.contains(F.lower("text"), "term"))
    assert text.merged(found).where("file = 'sub/b.txt'").first().term == "needle"


def test_seed_classes(spark):
    lines = tree(spark)
    spans = spark.createDataFrame([("a.go", "f", 1, 2), ("a.go", "g", 3, 4)], "file string, id string, start int, end int")
    got = text.seeds_from_hits(text.hits(lines, "needle"), spans, spark.createDataFrame([("f",)], "id string"))
    assert sorted(map(tuple, got.collect())) == [("f", "confirmed"), ("g", "promoted"), ("sub/b.txt:1", "raw")]
    order = text.confirmed_first(spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos int"), spark.createDataFrame([("c",)], "id string"))
    assert [r.id for r in order.collect()] == ["c", "a", "b"]


def test_references_skip_comments_and_strings(spark):
    lines = split_lines(spark.createDataFrame([("a.go", 'x := Cfg{}\n// Cfg in a comment\ns := "Cfg"\nvar y Cfg // Cfg')], "file string, content string"))
    none = spark.createDataFrame([("a.go", 1, "Cfg"), ("b.go", 1, "Cfg")], "file string, line int, name string")
    r = text.references(lines, "Cfg", none).first()
    assert (r["count"], r["lines"], r["ambiguous"]) == (2, [1, 4], True)


def test_notes(spark):
    hits = spark.range(12).select(F.lit("a").alias("file"), "id")
    refs = spark.createDataFrame([("a", 3)], "file string, count long")
    note = lambda h, r, d: text.noise_note(h, r, d).first().note
    assert [note(hits, refs, 1), note(hits, refs, 2), note(hits.limit(9), refs, 2), note(hits, refs.limit(0), 1)] == ["noise", "ambiguous", "", ""]


def test_ranged_read(spark):
    lines = tree(spark)
    assert [tuple(r) for r in text.read_range(lines, "a.go", 2, 2).orderBy("line").collect()] == [(2, "func Needle() {}", 4, False), (3, "", 4, False)]
    assert tuple(text.read_range(lines, "a.go", 9).first()) == (None, None, 4, True)


def test_cached_files_list_lines_alone(spark):
    hits = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "file string, line int, text string")
    now = spark.createDataFrame([("a", "h1"), ("b", "h2")], "file string, content_hash string")
    sent = spark.createDataFrame([("a", "h1"), ("b", "old")], "file string, content_hash string")
    assert sorted((r.file, r.text) for r in text.cached_lines(hits, now, sent).collect()) == [("a", None), ("b", "x")]
