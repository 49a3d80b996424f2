import pytest
from pyspark.sql import functions as F

from impactgraph.operators import session, verify
from impactgraph.sources import files
from impactgraph.sources.adapters import split_lines


def test_confidence(spark):
    df = spark.createDataFrame([(0, 100), (29, 100), (30, 100), (69, 100), (70, 100), (5, 0)], "s long, w int")
    assert [r.c for r in df.select(session.confidence(F.col("s"), F.col("w")).alias("c")).collect()] == ["high", "high", "medium", "medium", "low", "low"]


def test_strategies(spark):
    rows = [(c, same, sure, delta) for c, same, sure, delta in [(0, False, "high", False), (1, True, "low", False), (2, True, "high", False), (2, True, "medium", False), (2, True, "low", False), (3, True, "high", False), (3, True, "low", False), (4, False, "high", True), (4, False, "high", False)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, count int, same boolean, sure string, delta boolean")
    got = [r.s for r in df.select("i", session.strategy(F.col("count"), F.col("same"), F.col("sure"), F.col("delta")).alias("s")).orderBy("i").collect()]
    assert got == ["full-fresh", "sha-pointer", "sha-pointer", "session-signature", "full-fresh", "sha-pointer", "escalated-full", "semantic-delta", "full-fresh"]


def test_read_log(spark):
    rows = [("s", "f", 1, i, 10) for i in range(5)] + [("s", "f", 2, 5, 10), ("s", "g", 1, 2, 900)]
    log = spark.createDataFrame(rows, "session string, file string, content_hash int, seq int, tokens long").withColumn("ts", F.timestamp_seconds("seq"))
    got = {(r.file, r.seq): (r.strategy, r.since) for r in session.read_strategies(log, 1000).collect()}
    assert got[("f", 1)] == ("sha-pointer", 0) and got[("f", 3)] == ("escalated-full", 920) and got[("f", 5)][0] == "full-fresh"
    assert [(r.file, r.rank) for r in session.recent(log, 1).collect()] == [("f", 1)]


def test_caps(spark):
    df = spark.createDataFrame([(0, "sha-pointer", 10, 12), (1, "full-fresh", 90000, 90000), (2, "sha-pointer", 100, 3)], "i int, s string, o long, d long")
    s, d = session.capped(F.col("s"), F.col("o"), F.col("d"))
    assert [tuple(r) for r in df.orderBy("i").select(s, d).collect()] == [("full-fresh", 10), ("full-fresh", 50000), ("sha-pointer", 3)]


def test_ledger(spark):
    calls = spark.createDataFrame([("a", 100, 25), ("a", None, None), ("b", 0, 0)], "tool string, original long, delivered long")
    got = {r.tool: (r.calls, r.original, r.delivered, r.savings_percent) for r in session.ledger(calls).collect()}
    assert got == {"a": (2, 100, 25, 75.0), "b": (1, 0, 0, 0.0), "total": (3, 100, 25, 75.0)}
    assert session.ledger(calls.limit(0)).first().calls == 0


def code(spark, second="two"):
    return split_lines(spark.createDataFrame([("f", f"head\nfunc a\none\nfunc b\n{second}\ntail")], "file string, content string"))


SPANS = [("f", "a", 2, 3), ("f", "b", 4, 5)]


def test_symbol_shas_and_delta(spark):
    make = lambda rows: spark.createDataFrame(rows, "file string, key string, start int, end int")
    spans = make(SPANS)
    assert session.symbol_shas(code(spark), make([*SPANS, ("f", "b", 1, 1), ("f", "z", 6, 99)])).count() == 1
    before = session.symbol_shas(code(spark, "other"), spans)
    got = session.semantic_delta(code(spark), spans, before).first()
    lines = got.content.split("\n")
    assert got.pointers == 1 and lines[0] == "head" and lines[1].startswith("… [a unchanged, sha ") and lines[2:] == ["func b", "two", "tail"]
    same = session.symbol_shas(code(spark), spans)
    assert session.sha_drift(before, same).collect()[0].asDict() == {"file": "f", "key": "b", "change": "changed"}
    overlap = make([("f", "a", 2, 4), ("f", "b", 4, 5)])
    assert session.semantic_delta(code(spark), overlap, session.symbol_shas(code(spark), overlap)).isEmpty()
    assert session.semantic_delta(code(spark), spans, before.where("key = 'b'")).isEmpty()


def test_graph_deliveries(spark):
    big = "x" * 4000
    rows = [("s", "k", 1, big, "low"), ("s", "k", 2, big, "low"), ("s", "k", 3, big, "low"), ("s", "k", 4, big, "high"), ("s", "k", 5, big + "y", "high"), ("s", "small", 1, "x", "high"), ("s", "small", 2, "x", "high")]
    got = session.graph_deliveries(spark.createDataFrame(rows, "session string, key string, seq int, payload string, confidence string"))
    assert [r.pointer for r in got.orderBy("key", "seq").collect()] == [False, True, False, True, False, False, False]
    assert session.delivery_key("t", {"b": 1, "a": 2, "model": "m"}) == 'graph://t?{"a":2,"b":1}'


def test_file_drift(spark):
    sent = spark.createDataFrame([("a", "1", 0), ("b", "1", 1), ("c", "1", 2), ("graph://x", "1", 3), ("d", "1", 600)], "file string, content_hash string, pos int")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, content_hash string")
    merges = files.merge_records(spark.createDataFrame([('[{"file": "b", "order": 1, "added": ["y"], "changed": ["x"]}]',)], "json string"))
    assert [tuple(r) for r in merges.collect()] == [("b", "changed", "x"), ("b", "added", "y")]
    assert sorted(map(tuple, session.file_drift(sent, now, merges).collect())) == [("b", "changed", "merge"), ("c", "deleted", "edit")]
    assert tuple(session.stale_warning(sent, now).first()) == (2, ["b", "c"])


def test_symbol_drift(spark):
    shape = "file string, name string, signature string, body string"
    base = spark.createDataFrame([("f", "Login", "()", "b1"), ("f", "Logout", "()", "b2"), ("f", "Old", "()", "b3"), ("f", "Same", "()", "b4"), ("f", "Body", "()", "b5")], shape)
    head = spark.createDataFrame([("f", "Login", "(x)", "b1"), ("f", "New", "()", "b3"), ("f", "Same", "()", "b4"), ("f", "Added", "()", "b9"), ("f", "Body", "()", "b6")], shape)
    got = {r.name: (r.change, r.breaking, r.renamed_from) for r in session.symbol_drift(base, head).collect()}
    assert got == {"Login": ("changed", True, None), "Logout": ("removed", True, None), "New": ("renamed", True, "Old"), "Added": ("added", False, None), "Body": ("changed", False, None)}


def test_index_delta(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x")], "file string, sha string")
    b = spark.createDataFrame([("1", "x"), ("2", "y"), ("4", "x")], "file string, sha string")
    assert tuple(session.index_delta(a, b).first()) == (3, 2, 1, 1)


def test_compaction(spark):
    rows = [(1, i, "user", "exploration" if i in (0, 2, 4) else "", ("same " if i in (0, 2, 4) else str(i)) * 100) for i in range(8)]
    got = session.compact(spark.createDataFrame(rows, "conv_id int, turn int, role string, kind string, content string")).orderBy("turn").collect()
    assert [r.content for r in got[5:]] == [r[4] for r in rows[5:]]
    assert got[0].content == "[dedup] previous exploration repeated" and got[0].role == "system"
    # Later repeats of the same exploration stay, each as a line of reference.
    assert got[2].content == got[4].content == "[exploration] " + ("same " * 100).strip()[:120] + "…"
    assert got[1].content == "1" * 100 and got[0].delivered == got[2].delivered
    saved = session.compaction_savings(session.compact(spark.createDataFrame(rows, "conv_id int, turn int, role string, kind string, content string"))).first()
    assert 0 < saved.savings_percent < 100


def test_phases(spark):
    df = spark.createDataFrame([(0, "Fix the crash"), (1, "review the diff and add tests"), (2, "explain"), (3, "hello"), (4, "review and fix")], "i int, t string")
    votes, best = session.phase(F.col("t"))
    assert [r.p for r in df.select("i", best.alias("p")).orderBy("i").collect()] == ["debug", "review", "explore", "unknown", "debug"]


CALLERS = [(f"c{i}", "Do", f"{'a' if i < 3 else 'b'}.go", 10 * i + 1, 10 * i + 8) for i in range(6)]


@pytest.mark.parametrize("updated, missed", [({0, 1, 3}, {2, 4, 5}), (set(range(6)), set())])
def test_missed_sites(spark, updated, missed):
    required = spark.createDataFrame(CALLERS, "symbol string, seed string, file string, start int, end int")
    calls = spark.createDataFrame([(f"c{i}", "s.Do" if i % 2 else "Do", 10 * i + 5) for i in range(6)] + [("c0", "Other", 2), ("c1", "UnDo", 12)], "symbol string, callee string, line int")
    changed = spark.createDataFrame([(CALLERS[i][2], 10 * i + 5, 10 * i + 5) for i in updated], "file string, start int, end int")
    got = verify.missed(required, calls, changed)
    assert {int(r.symbol[1:]) for r in got.collect()} == missed
    state = verify.verdict(changed, got, spark.createDataFrame([], "x int"), spark.createDataFrame([], "level string")).first().verdict
    assert state == ("incomplete" if missed else "complete")


def test_span_fallback(spark):
    required = spark.createDataFrame(CALLERS[:2], "symbol string, seed string, file string, start int, end int")
    none = spark.createDataFrame([], "symbol string, callee string, line int")
    changed = spark.createDataFrame([("a.go", 8, 9)], "file string, start int, end int")
    assert [(r.symbol, r.line, r.detail) for r in verify.missed(required, none, changed).collect()] == [("c1", 11, "span")]


def test_verdicts(spark):
    one, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "x int")
    level = lambda *x: spark.createDataFrame([(v,) for v in x], "level string")
    got = lambda *a: verify.verdict(*a).first().verdict
    assert [got(none, one, one, level()), got(one, one, none, level()), got(one, none, one, level()), got(one, none, none, level("fail")), got(one, none, none, level("review")), got(one, none, none, level())] == ["clean", "incomplete", "review", "incomplete", "review", "complete"]
    assert [verify.exit_code("incomplete"), verify.exit_code("review"), verify.exit_code("review", True), verify.exit_code("complete")] == [1, 0, 1, 0]


def test_diff_ranges_and_seeds(spark):
    diff = files.diff_lines(spark, "--- a/x.go\n+++ b/x.go\n@@ -1,2 +3,4 @@ f\n-p\n-q\n+a\n+b\n+c\n+d\n@@ -9 +12 @@\n-r\n+s\n@@ -20,3 +19,0 @@\n-t\n-u\n-v\n--- a/y.go\n+++ b/y.go\n@@ -1 +0,0 @@\n-w")
    assert sorted(map(tuple, verify.ranges(diff).collect())) == [("x.go", 3, 6), ("x.go", 12, 12), ("x.go", 19, 19), ("y.go", 1, 1)]
    spans = spark.createDataFrame([("x.go", "a", 1, 3), ("x.go", "b", 7, 11)], "file string, key string, start int, end int")
    assert [r.key for r in verify.touched_spans(spans, verify.ranges(diff)).collect()] == ["a"]
    d = spark.createDataFrame([("f", "a.go", "function", "changed", True), ("g", "a.go", "function", "changed", False), ("h", "a.go", "const", "removed", False), ("i", "a_test.go", "function", "removed", False), ("j", "a.go", "document", "removed", False), ("k", "a.go", "method", "renamed", False)], "name string, file string, kind string, change string, signature_changed boolean")
    assert sorted((r.name, r.because, r.state) for r in verify.seeds(d, None).collect()) == [("f", "signature", "seed"), ("h", "removed", "unverified"), ("k", "renamed", "seed")]
    with pytest.raises(ValueError):
        verify.check_ref("--output=x")


def test_parameters(spark):
    assert verify.parameter_list("func (s S) Do(a int,\n  f func(x int)) error", "Do") == "a int, f func(x int)"
    assert verify.parameter_list("void put(", "put") is None and verify.parameter_list("output(a)", "put") is None
    side = lambda t: spark.createDataFrame([("f", 1, "put", t)], "file string, line int, name string, text string")
    assert verify.member_changes(side("void put(int a)"), side("void put(int  a);")).isEmpty()
    assert verify.member_changes(side("void put(int a)"), side("void put(long a)")).first().p1 == "long a"


def test_parameter_rows(spark):
    lists = [("a: Map<K, V>, b = (1, 2)", "ts"), ("ctx Context, f func(a, b int) error", "go"), ("final int x, List<String> y", "java"), ("self, x", "python"), ("  ", ""), ("", "")]
    rows = verify.parameter_rows(spark.createDataFrame(lists, "params string, language string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault(r.params, []).append((r.arity, r.param, r.type))
    assert got == {
        lists[0][0]: [(2, "a: Map<K, V>", "Map<K, V>"), (2, "b = (1, 2)", "b = (1, 2)")], lists[1][0]: [(2, "ctx Context", "Context"), (2, "f func(a, b int) error", "func(a, b int) error")],
        lists[2][0]: [(2, "final int x", "final int"), (2, "List<String> y", "List<String>")], lists[3][0]: [(2, "self", "self"), (2, "x", "x")],
    }


MATCHES = [
    ("int a", "int a", "", [], True), ("int a", "int b", "java", [], True), ("int a", "int b", "", [], False), ("int a", "long a", "java", [], False), ("int a", "int a, int b", "java", [], False), ("int a, int b", "int a", "java", [], False),
    ("T value, int n", "String s, int n", "java", [], True), ("String s, int n", "T value, int n", "java", [], False), ("List<T> v", "List<String> v", "java", ["T"], True), ("TKey k", "String s", "java", ["TKey"], True),
    ("TKey k", "String s", "java", [], False), ("T k", "String s", "java", ["TKey"], False), ("x: T", "y: number", "ts", [], True), ("a: A, b", "a: A, c", "python", ["Q"], False), ("int a", "", "java", [], False), ("T1 a", "int b", "java", [], False),
]


def test_parameter_matches(spark):
    got = verify.parameter_matches(spark.createDataFrame([m[:4] for m in MATCHES], "base string, params string, language string, variables array<string>")).collect()
    assert {(r.base, r.params, r.language, tuple(r.variables)) for r in got} == {(*m[:3], tuple(m[3])) for m in MATCHES if m[4]}


def test_families_and_survivors(spark):
    """Over 60 members and over 60 callers of one: the first 60 members are looked at, and none of their callers is left out."""
    members = [(f"m{i:03}", "put", "method", "int x", f"f{i:03}.java", 10, 14) for i in range(100)] + [("two", "put", "method", "int x, int y", "g.java", 1, 2), ("cls", "put", "class", "int x", "g.java", 3, 4), ("nul", "put", "method", None, "g.java", 7, 8), ("self", "put", "method", "long x", "own.java", 5, 9), ("m999", "put", "method", "int z", "f000.java", 10, 14)]
    callers = [(f"c{i:03}", f"call{i}", "function", "", "c.java", 10 * i, 10 * i + 5) for i in range(150)]
    symbols = spark.createDataFrame(members + callers, "id string, name string, kind string, params string, file_path string, start int, end int")
    calls = [(f"c{i:03}", "m000") for i in range(100)] + [(f"c{100 + i:03}", f"m{40 + i:03}") for i in range(50)] + [("m001", "m000"), ("c000", "m000"), ("self", "m002")]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in calls], "src string, dst string, type string")
    seed = spark.createDataFrame([("put", "int old", "java", "own.java", 5)], "name string, params string, language string, file_path string, start int")
    family = {r.id for r in verify.base_contract_family(symbols, seed).collect()}
    assert family == {f"m{i:03}" for i in range(100)} | {"m999"}
    got = {r.symbol for r in verify.survivors(symbols, edges, seed).collect()}
    assert got == {f"m{i:03}" for i in range(100)} | {f"c{i:03}" for i in range(120)} | {"self"}
    assert verify.survivors(symbols, edges, seed.withColumn("new_params", F.col("params"))).isEmpty() and verify.survivors(symbols.limit(0), edges, seed).isEmpty()


def test_nested_scope():
    code = ["def outer():", "    def inner():", "        x()", "    y()"]
    assert verify.nested_scope(code, 3) == "def inner():" and verify.nested_scope(code, 4) is None and verify.nested_scope(code, 99) is None


def test_dependencies_by_touch(spark):
    sites = spark.createDataFrame([("a", "b", "f", 1), ("a", "b", "f", 5), ("c", "d", "f", 1)], "src_comp string, dst_comp string, src_file string, src_line int")
    changed = spark.createDataFrame([("f", 1, 2)], "file string, start int, end int")
    assert [tuple(r) for r in verify.new_dependencies(sites, changed).collect()] == [("c", "d", 1)]
    bad = spark.createDataFrame([("a", "b", "heuristic"), ("c", "d", "precise"), ("x", "y", "precise")], "src_comp string, dst_comp string, min_tier string")
    assert sorted((r.src_comp, r.level) for r in verify.introduced_violations(sites, changed, bad).collect()) == [("a", "review"), ("c", "fail")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.go").write_text("x\ny")
    (tmp_path / "sub" / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "sub" / "c.txt").write_text("é")
    (tmp_path / "node_modules" / "d.js").write_text("z")
    assert sorted(map(tuple, files.tree(spark, str(tmp_path)).collect())) == [("a.go", "x\ny"), ("sub/c.txt", "é")]
    assert [files.inside("/r", p) for p in ("a/../b", "../x", "/r/a", "/etc", "./a")] == ["b", None, "a", None, "a"]
    got = files.settings("model: m # c\n# x: y\narch_deny: a -> b\narch_deny: c -> d\nbudget: 9\nport: 1")
    assert (got.model, got.arch_deny, got.budget, got.other) == ("m", ["a -> b", "c -> d"], 9, {"port": "1"})
    touched = files.touches(spark, "@86400\na.go\n\nb.go\n@0\na.go")
    assert sorted((r.file, r.ts.day) for r in touched.collect()) == [("a.go", 1), ("a.go", 2), ("b.go", 2)]
    path = str(tmp_path / "ledger")
    assert files.load(spark, path, "tool string, calls long").isEmpty()
    files.save(spark.createDataFrame([("t", 2)], "tool string, calls long"), path)
    assert tuple(files.load(spark, path, "tool string, calls long").first()) == ("t", 2)
    files.save(spark.createDataFrame([("u", 3)], "tool string, calls long"), path)
    (tmp_path / "ledger" / "99999999999999999999").mkdir()  # begun, not finished
    assert [tuple(r) for r in files.load(spark, path, "tool string, calls long").collect()] == [("u", 3)]
    diff = "--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+++ b\n+c\n--- a/y\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-p\n-q\n"
    assert [tuple(r) for r in files.diff_lines(spark, diff).select("file", "text", "deleted").collect()] == [("x", "@@ -1 +1,2 @@", False), ("y", "@@ -1,2 +0,0 @@", True)]


def test_long_blocks_are_few_rows(spark):
    """A block meets its lines by stretches, with its first and last line and not beyond."""
    blocks = spark.createDataFrame([("f", "b", 63, 640), ("f", "c", 64, 64), ("f", "d", 9, 8)], "file string, block string, start int, end int")
    lines = spark.createDataFrame([("f", i, f"op{i}(a)") for i in (62, 63, 64, 127, 128, 640, 641)] + [("g", 64, "op(a)")], "file string, line int, text string")
    got = verify.block_lines(lines, blocks)
    assert sorted((x.block, x.line) for x in got.collect()) == [("b", 63), ("b", 64), ("b", 127), ("b", 128), ("b", 640), ("c", 64)]
    assert "floor" in got._jdf.queryExecution().optimizedPlan().toString().lower()
