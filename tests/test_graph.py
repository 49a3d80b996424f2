import pytest
from pyspark.sql import functions as F

from impactgraph.operators import graph
from tests.test_view import EDGE, SYM


def edges(spark, rows, kind="calls"):
    return spark.createDataFrame([(a, b, kind, "native", 1.0) for a, b in rows], EDGE)


def ids(df):
    return sorted(r.id for r in df.collect())


CALLS = [("format", "add"), ("direct", "add"), ("run", "format"), ("main", "run"), ("add_test", "add"), ("mul_test", "mul"), ("noise", "other")]


def test_impact(spark):
    e = edges(spark, CALLS)
    seed = lambda x: spark.createDataFrame([(x,)], "id string")
    assert ids(graph.impact(e, seed("add"))) == ["add_test", "direct", "format", "main", "run"]
    assert ids(graph.impact(e, seed("add"), 1)) == ["add_test", "direct", "format"]
    assert ids(graph.impact(e, seed("mul"))) == ["mul_test"]
    assert ids(graph.impact(e.limit(0), seed("add"))) == []


def test_reach_ends_on_cycles(spark):
    got = graph.reach(edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]), spark.createDataFrame([("a",)], "id string"))
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_kinds_are_checked(spark):
    with pytest.raises(ValueError, match="unknown edge kinds: tests"):
        graph.check_kinds(["calls", "tests"])


def test_neighbors(spark):
    s = spark.createDataFrame([(x, f"{x}/{'mock' if x == 'direct' else 'f'}.go", "function", x, "", True, 1, 2) for x in ("add", "format", "direct", "run")], SYM)
    e, seed = edges(spark, CALLS), spark.createDataFrame([("format",), ("add",)], "id string")
    got = sorted((r.seed, r.neighbor, r.direction, r.test_double) for r in graph.neighbors(e, s, seed).collect())
    assert got == [("add", "direct", "in", True), ("add", "format", "in", False), ("format", "add", "out", False), ("format", "run", "in", False)]
    assert graph.call_neighbors(e, s, seed).count() == 3 and graph.callers(e, s, seed).count() == 3
    many = edges(spark, [(f"n{i:03}", "hub") for i in range(60)])
    names = spark.createDataFrame([(f"n{i:03}", "f.go", "function", "n", "", True, 1, 2) for i in range(60)], SYM)
    top = graph.capped_groups(graph.neighbors(many, names, spark.createDataFrame([("hub",)], "id string")))
    assert (top.count(), top.first().total) == (50, 60)


def test_file_edges_and_dependents(spark):
    s = spark.createDataFrame([("1", "a.go", "function", "f", "", True, 1, 2), ("2", "a.go", "function", "g", "", True, 3, 4), ("3", "b.go", "function", "h", "", True, 1, 2)], SYM)
    assert graph.file_edges(edges(spark, [("1", "2"), ("1", "3"), ("3", "2"), ("3", "3")]), s, "a.go").count() == 3
    e = edges(spark, [("b.go::B@1", "a.go::A@2"), ("file:c.go", "a.go::A@2"), ("a.go::X@1", "a.go::A@2"), ("b.go::Z@3", "a.go::A@2")])
    assert [r.file for r in graph.dependents(e, "a.go").collect()] == ["b.go", "c.go"]


TYPED = SYM + ", parent string, params string, abstract boolean, other_calls boolean"


def typed(spark):
    row = lambda i, kind, name, parent="", params="", abstract=False, start=1, end=3: (i, f"{i}.java", kind, name, "", True, start, end, parent, params, abstract, False)
    s = [row("I", "interface", "Sink"), row("C", "class", "File"), row("D", "class", "Sub"), row("E", "class", "Bare"), row("X", "class", "Ext"), row("A", "class", "Abs", abstract=True), row("I.put", "method", "put", "I"), row("C.put", "method", "put", "C"), row("use", "function", "use"), row("O.put", "method", "put", "O")]
    e = [("C", "I", "implements"), ("D", "C", "extends"), ("E", "I", "implements"), ("X", "I", "implements"), ("X", "outside", "extends"), ("A", "I", "implements"), ("use", "C.put", "calls")]
    return spark.createDataFrame(s, TYPED), spark.createDataFrame([(a, b, k, "native", 1.0) for a, b, k in e], EDGE)


def test_change_impact(spark):
    s, e = typed(spark)
    got = graph.change_impact(s, e, "Sink", "put")
    assert sorted((r.role, r.id) for r in got.collect()) == [("caller", "use"), ("declaration", "I.put"), ("declaring_type", "C"), ("declaring_type", "I"), ("family", "C.put")]
    assert graph.total_sites(got).first().total_sites == 5
    assert graph.completeness(s, e, got).first().completeness == "closed"
    up = graph.change_impact(s, e, "File", "put")
    assert ("super", "I.put") in {(r.role, r.id) for r in up.collect()}
    assert [(r.role, r.id) for r in graph.change_impact(s, e, None, "use").collect()] == [("declaration", "use")]


def test_total_sites_of_the_small_fixture(spark):
    s, e = typed(spark)
    s, e = s.where("id IN ('I', 'I.put', 'C', 'C.put', 'use')"), e.where("src IN ('C', 'use')")
    got = graph.change_impact(s, e, "Sink", "put")
    assert graph.total_sites(got.where("id <> 'C'")).first().total_sites == 4


def test_missing_implementations(spark):
    s, e = typed(spark)
    got = {r.id: r.status for r in graph.missing_implementations(s, e, "Sink", "put").collect()}
    assert got == {"C": "implemented", "D": "inherited", "E": "missing", "X": "unverifiable", "A": "abstract_missing"}


def test_rename_and_apply(spark):
    s, e = typed(spark)
    files = spark.createDataFrame([("I.put.java", "void put();\n}\n"), ("C.put.java", "// output\r\nvoid put() {}\r\nx"), ("use.java", "f.put();\nputs()")], "file string, content string")
    from impactgraph.sources.adapters import split_lines

    plan = graph.rename_plan(graph.change_impact(s, e, "Sink", "put"), split_lines(files), s, "put", "store")
    rows = sorted((r["file"], r["line"], r["after"], r["class"]) for r in plan.collect())
    assert rows == [("C.put.java", 2, "void store() {}\r", "edit"), ("I.put.java", 1, "void store();", "edit"), ("use.java", 1, "f.store();", "edit")]
    with pytest.raises(ValueError):
        graph.rename_plan(plan, files, s, "put", "a-b")
    edits = plan.select("file", "line", F.regexp_replace("before", "\r$", "").alias("before"), F.regexp_replace("after", "\r$", "").alias("after"))
    stale = spark.createDataFrame([("use.java", 2, "other", "x"), ("gone.java", 1, "a", "b")], "file string, line int, before string, after string")
    whole, counts = graph.apply_edits(files, edits.union(stale))
    got = {r.file: r.content for r in whole.collect()}
    assert got == {"I.put.java": "void store();\n}\n", "C.put.java": "// output\r\nvoid store() {}\r\nx", "use.java": "f.store();\nputs()"}
    assert tuple(counts.first()) == (3, 2)


def test_dead_code(spark):
    rows = [("m", "main", False), ("u", "used", False), ("d", "dead", False), ("w", "word", False), ("x", "Exported", True)]
    s = spark.createDataFrame([(i, "a.go", "function", n, "", ex, 1, 2) for i, n, ex in rows], SYM)
    words = spark.createDataFrame([("word", 2), ("dead", 1)], "word string, n long")
    got = graph.dead_code(s, edges(spark, [("m", "u"), ("d", "w")]), words)
    assert sorted(map(tuple, got.collect())) == [("d", "dead"), ("x", "exported_unreferenced")]


def test_wider_anchor(spark):
    rows = [("s", "Handle", 2, True, False, 0), ("a", "Handle", 5, True, False, 1), ("b", "Handle", 9, False, False, 2), ("c", "Handle", 5, True, False, 3), ("t", "Handle", 99, True, True, 4)]
    sizes = spark.createDataFrame(rows, "id string, leaf string, sites long, closed boolean, test_double boolean, pos int")
    assert tuple(graph.wider_anchor(sizes, "s").first()) == ("a", 5, 2)
    assert graph.wider_anchor(sizes.where("id IN ('s', 'a')"), "s").isEmpty()
