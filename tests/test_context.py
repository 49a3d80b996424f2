from pyspark.sql import functions as F

from impactgraph.operators import context, graph
from impactgraph.sources.adapters import split_lines
from tests.test_graph import TYPED, typed
from tests.test_view import EDGE

FULL = "id string, file_path string, kind string, name string, qualified_name string, language string, signature string, docstring string, raw_text string, start int, end int, calls int"


def project(spark):
    row = lambda i, path, name, start, end, doc="": (i, path, "function", name, "", "go", f"func {name}()", doc, f"func {name}() {{ ... }}", start, end, 1)
    s = [row("a", "p/a.go", "Alpha", 1, 2), row("b", "p/b.go", "Beta", 1, 3), row("c", "p/c.go", "Gamma", 1, 2), row("t", "p/a_test.go", "TestAlpha", 1, 2), row("z", "p/z.go", "Zed", 1, 2)]
    e = [("b", "a", "calls", "native", 1.0), ("a", "c", "calls", "native", 1.0)]
    lines = split_lines(spark.createDataFrame([("p/a.go", "func Alpha()\n}"), ("p/b.go", "func Beta() {\nAlpha()\n}"), ("p/z.go", "none\n")], "file string, content string"))
    return spark.createDataFrame(s, FULL), spark.createDataFrame(e, EDGE), lines


def test_select_context(spark):
    s, e, lines = project(spark)
    terms = spark.createDataFrame([(0, "alpha")], "pos int, term string")
    stats = spark.createDataFrame([("p/b.go", 0, 20)], "file string, last_edit_days long, commits_90d long")
    seen = spark.createDataFrame([("p/c.go", "high")], "file string, confidence string")
    got = {r.id: (r.category, r.disclosure) for r in context.select_context(s, e, lines, terms, stats, seen, 4000).collect()}
    assert got["a"] == ("target", "full") and got["b"] == ("target", "full") and "z" not in got and "t" not in {k for k, v in got.items() if v[0] != "target"}
    assert got.get("c", ("dependency", "reference")) == ("dependency", "reference")


def test_node_view(spark):
    s, e, _ = project(spark)
    assert {(r.section, r.id) for r in context.node_view(s, e, "p/a.go").collect()} == {("symbol", "a")}
    assert {(r.section, r.id, r.detail) for r in context.node_view(s, e, "Alpha").collect()} == {("symbol", "a", "function"), ("edge", "b", "calls in"), ("edge", "c", "calls out")}


def test_impact_with_fallback(spark):
    s, e = typed(spark)
    got = context.change_impact_or_callers(s, e, [("Nope", "put"), ("Sink", "put")])
    assert {r.role for r in got.collect()} == {"declaration", "family", "caller", "declaring_type"}
    only = context.change_impact_or_callers(s, e, [("Nope", "put")])
    assert [(r.role, r.id) for r in only.collect()] == [("caller", "use")]
    note = context.structural_note(got, 1).first()
    assert (note.family, note.callers, note.first_callers) == (1, 1, ["use"]) and context.structural_note(got, 2).isEmpty()
    assert {r.role: r.n for r in context.result_summary(got).collect()}["declaring_type"] == 2


def test_small_ones(spark):
    s, *_ = project(spark)
    marked = s.withColumn("raw_text", F.when(F.col("id") == "b", "## generated").otherwise(F.col("raw_text")))
    assert {r.id for r in context.without_generated(marked, ["p/z.go"], ["p/a.go", "p/b.go"], "## generated").collect()} == {"a", "c", "t"}
    assert context.pointer_summary({"callers": [1, 2], "query": "q", "x": 1}) == {"callers": 2, "query": "q"}
    assert context.canonical({"b": "é", "a": [1]}) == '{"a":[1],"b":"é"}'
    assert context.with_stale_warning(s, None).first().stale_warning is None
    old = spark.createDataFrame([("a", "2001-01-01"), ("b", "2001-11-30")], "name string, t string").select("name", F.to_timestamp("t").alias("modified"))
    assert [r.name for r in context.prune(old, F.to_timestamp(F.lit("2001-12-01"))).collect()] == ["a"]
    assert graph.cut_lineage(s).count() == 5 and TYPED
