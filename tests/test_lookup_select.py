from pyspark.sql import functions as F

from impactgraph.operators import lookup, select

SYM = "id string, name string, qualified_name string, file_path string, start int, kind string, signature string, docstring string, raw_text string, language string"


def symbols(spark):
    row = lambda i, name, q, path, sig="": (i, name, q, path, 1, "method", sig, "", "body", "go")
    return spark.createDataFrame([row("1", "Get", "Store.Get", "kv/store.go"), row("2", "Get", "Cache.Get", "cache/c.go"), row("3", "Get", "Store.Get", "kv/mock_store.go"), row("4", "GetAll", "Store.GetAll", "kv/store.go"), row("5", "Put", "Store.Put", "kv/store.go", "calls Get")], SYM)


def test_lookup(spark):
    s = symbols(spark)
    ids = lambda df: sorted((r.id, r.ambiguous) for r in df.collect())
    assert ids(lookup.lookup(s, "Store.Get")) == [("1", False)]
    assert ids(lookup.lookup(s, "Get")) == [("1", True), ("2", True)]
    assert ids(lookup.lookup(s, "Get", file="cache")) == [("2", False)]
    assert ids(lookup.lookup(s, "cache.Get")) == [("2", False)]
    assert ids(lookup.lookup(s, "Get", file="nowhere")) == [("1", True), ("2", True)]
    assert ids(lookup.lookup(s, "Nope")) == []


def test_search_and_resolve(spark):
    s = symbols(spark)
    assert [r.id for r in lookup.search(s, "get").collect()] == ["2", "3", "1", "4", "5"]
    assert lookup.did_you_mean(s, "Ge").count() == 0
    assert [r.id for r in lookup.resolve(s, "Store.Get").collect()] == ["3", "1"]
    assert [r.id for r in lookup.resolve(s, "Get").collect()] == ["2", "1", "3"]
    assert lookup.projected(s, ["body", "kind", "what"]).columns == ["name", "file_path", "start", "raw_text", "kind"]
    assert lookup.compact_sites(s.withColumn("qualified_name", F.lit(""))).first().qualified_name == "Get"
    seeds = lookup.term_seeds(s, spark.createDataFrame([(0, "Get"), (1, "Put")], "pos int, term string"), limit=3)
    assert [r.id for r in seeds.orderBy("pos").collect()][:3] == ["1", "2", "4"]
    twice = s.withColumn("pos", F.lit(2)).union(s.withColumn("pos", F.lit(1)))
    assert {r.pos for r in lookup.first_by_id(twice).collect()} == {1}


def test_signals_and_scores(spark):
    touched = spark.createDataFrame([("2001-11-30 12:00:00", "a"), ("2001-10-01 00:00:00", "a"), ("1999-01-01 00:00:00", "b"), ("2001-06-01 00:00:00", "c")], "t string, file string").select(F.to_timestamp("t").alias("ts"), "file")
    stats = select.touch_stats(touched, F.lit("2001-12-01"))
    assert sorted(map(tuple, stats.collect())) == [("a", 0, 2), ("c", 183, 0)]
    got = select.signals(spark.createDataFrame([("a", 0, 0.0), ("b", None, None)], "file string, distance int, tested double"), stats)
    a, b = sorted(got.select("file", "graph_distance", "recency", "edit_frequency", select.score("nonsense").alias("s")).collect())
    assert (a.graph_distance, a.recency, a.edit_frequency) == (1.0, 1.0, 0.1)
    assert (b.graph_distance, round(b.recency, 6), b.edit_frequency) == (0.0, round(1 / (1 + 365 / 30), 6), 0.0)
    assert round(a.s, 6) == round(0.3333 + 0.2667 + 0.02, 6)


def test_learning_is_ordered_and_clamped(spark):
    rows = [("default", i, 30.0, 0.0, False) for i in range(2)] + [("default", 2, 0.0, 10.0, True)]
    got = select.learn(spark.createDataFrame(rows, "name string, seq int, cited double, uncited double, missing_tests boolean")).first()
    assert (round(got.graph_distance, 9), got.test_relevance) == (0.3, 0.04)
    base = spark.createDataFrame([("default", 0.3333, 0.2667, 0.2, 0.2), ("x", 0.1, 0.1, 0.1, 0.1)], "name string, graph_distance double, recency double, test_relevance double, edit_frequency double")
    low = spark.createDataFrame([("default", -0.4, 0.0, 0.04, 0.0)], base.schema)
    got = {r.name: r for r in select.apply_learned(base, low).collect()}
    assert (got["default"].graph_distance, round(got["default"].test_relevance, 9), got["x"].recency) == (0.05, 0.24, 0.1)
    fb = spark.createDataFrame([(1, 5), (2, 3), (3, 0), (4, 9)], "seq int, rating int")
    assert [(r.seq, r.cited) for r in select.feedback_outcomes(fb).orderBy("seq").collect()] == [(1, 1.0), (3, 0.0)]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "id string, score double, pos int, category string, wanted string, cost_full long, cost_signature long, cost_reference long")


def test_budget(spark):
    rows = [("a", 0.9, 0, "dependency", "full", 200, 20, 5), ("b", 0.8, 1, "dependency", "full", 200, 30, 5), ("c", 0.7, 2, "dependency", "full", 900, 900, 900), ("d", 0.6, 3, "dependency", "signature", 99, 19, 5), ("e", 0.6, 4, "doc", "reference", 500, 50, 5), ("f", 0.5, 5, "dependency", "full", 1, 1, 1)]
    got = sorted((r.id, r.disclosure, r.cost) for r in select.select(candidates(spark, rows), 1000).collect())
    # 250 tokens for dependencies: a in full, b's signature, c never, d's signature; f lies behind the cliff.
    assert got == [("a", "full", 200), ("b", "signature", 30), ("d", "signature", 19), ("e", "reference", 5)]
    assert select.select(candidates(spark, []), 1000).count() == 0


def test_disclosure(spark):
    rows = [("doc", False, "", False, 0.9), ("dependency", True, "high", False, 0.9), ("dependency", True, "medium", False, 0.9), ("dependency", True, "low", False, 0.9), ("dependency", False, "", True, 0.9), ("dependency", False, "", False, 0.1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, category string, seen boolean, confidence string, trivial boolean, score double")
    assert [r.d for r in df.select("i", select.disclosure().alias("d")).orderBy("i").collect()] == ["reference", "reference", "signature", "full", "signature", "signature"]


def test_rendering(spark):
    s = symbols(spark).where("id = '5'").withColumn("docstring", F.lit("Doc."))
    r = s.select(*[select.rendered(F.lit(x)).alias(x) for x in ("full", "signature", "reference")]).first()
    assert tuple(r) == ("body", "Doc.\ncalls Get", "method Store.Put (kv/store.go:1)")


def test_windows(spark):
    spans = spark.createDataFrame([("a", 10, 12, True), ("a", 20, 21, True), ("a", 90, 120, False), ("b", 5, 6, True), ("c", 1, 95, True)], "file string, start int, end int, full boolean")
    sizes = spark.createDataFrame([("a", 200), ("b", 80), ("c", 100)], "file string, lines int")
    got = sorted((r.file, r.start, r.end) for r in select.windows(spans, sizes).collect())
    assert got == [("a", 8, 23), ("a", 88, 99), ("b", 1, 80), ("c", 1, 100)]


def test_delivery(spark):
    sections = spark.createDataFrame([("a", 1, 150), ("b", 2, 60), ("c", 3, 50)], "file string, rank int, cost long")
    assert [r.state for r in select.deliver(sections, 100).orderBy("rank").collect()] == ["whole", "listed", "listed"]
    assert [r.state for r in select.deliver(sections, 60).orderBy("rank").collect()] == ["cut", "listed", "listed"]
    picked = spark.createDataFrame([("a", 0.5, 0), ("b", 0.9, 1), ("a", 0.7, 2)], "file string, score double, pos int")
    assert [(r.file, r.shown) for r in select.file_order(picked, 1).orderBy("rank").collect()] == [("b", True), ("a", False)]
    sizes = spark.createDataFrame([("a", 100), ("b", 41)], "file string, bytes long")
    assert select.baseline_tokens(picked, sizes, F.lit(10)).first()[0] == 35 and select.baseline_tokens(picked, sizes, F.lit(99)).first()[0] == 99


def test_summary_and_filters(spark):
    anchors = spark.createDataFrame([("x", 0), ("y", 1), ("x", 2)], "id string, pos int")
    calls = spark.createDataFrame([(f"s{i}", "x", f"f{i % 5}") for i in range(7)], "src string, dst string, src_file string")
    got = {r.id: (r.callers, r.files, r.more) for r in select.anchor_summary(anchors, calls).collect()}
    assert got == {"x": (7, ["f0", "f1", "f2"], 2), "y": (0, [], 0)}
    c = spark.createDataFrame([("test",), ("doc",), ("dependency",), ("target",)], "category string")
    assert [r.category for r in select.included(c).collect()] == ["dependency", "target"] and select.included(c, False, True).first().category == "doc"
    d = select.graph_distance(spark.createDataFrame([(True, False, 0), (False, True, 1), (False, False, 25)], "seed boolean, neighbor boolean, pos int"))
    assert [r.distance for r in d.orderBy("pos").collect()] == [0, 1, 5]
    seeds = spark.createDataFrame([(str(i), i, "n", "q", "k", "go", "sig", "doc", "r" * 8, "f", 1) for i in range(7)], "id string, pos int, name string, qualified_name string, kind string, language string, signature string, docstring string, raw_text string, file_path string, start int")
    assert [(r.cost, r.disclosure) for r in select.seeds_free(seeds).collect()] == [(2, "full")] * 5
