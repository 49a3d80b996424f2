import pytest
from pyspark.sql import functions as F

from impactgraph.operators import view

SYM = "id string, file_path string, kind string, name string, qualified_name string, exports boolean, start int, end int"
EDGE = "src string, dst string, type string, source string, confidence double"


def graph_of(spark):
    """Three folders of a shop: orders use stock twice over, stock uses ledger; a test, a text and unknown ids stand aside."""
    s = [
        ("place", "shop/orders/place.py", "function", "place", "", True, 10, 20), ("cancel", "shop/orders/cancel.py", "function", "cancel", "orders.cancel", False, 3, 8),
        ("hold", "shop/stock/hold.py", "function", "hold", "", True, 5, 9), ("book", "shop/ledger/book.py", "function", "book", "", True, 2, 7),
        ("readme", "shop/README.md", "document", "readme", "", False, 1, 4), ("probe", "shop/stock/test_hold.py", "function", "probe", "", False, 1, 6),
    ]
    e = [
        ("place", "hold", "calls", "astkit", 1.0), ("cancel", "hold", "calls", "astkit", 0.5), ("place", "hold", "uses-type", "", 1.0), ("hold", "book", "calls", "native", 1.0),
        ("place", "cancel", "calls", "native", 1.0), ("probe", "book", "calls", "native", 1.0), ("place", "nowhere", "calls", "native", 1.0), ("readme", "place", "imports", "native", 1.0), ("place", "book", "contains", "native", 1.0),
    ]
    return spark.createDataFrame(s, SYM), spark.createDataFrame(e, EDGE)


ORDERS, STOCK, LEDGER = "shop/orders", "shop/stock", "shop/ledger"


def test_view(spark):
    s, e = graph_of(spark)
    crossed = view.crossings(s, e)
    got = {(r.src_comp, r.dst_comp): r for r in view.ordered(view.as_maps(view.induced(crossed))).collect()}
    assert set(got) == {(ORDERS, STOCK), (STOCK, LEDGER)}
    first, last = got[ORDERS, STOCK], got[STOCK, LEDGER]
    assert (first.weight, first.kinds, first.tiers, first.min_tier) == (3, {"calls": 2, "uses-type": 1}, {"measured": 2, "heuristic": 1}, "heuristic")
    assert [(x.src_file, x.src_line) for x in first.sites] == [("shop/orders/cancel.py", 3), ("shop/orders/place.py", 10), ("shop/orders/place.py", 10)]
    assert (last.weight, last.tiers, last.min_tier) == (1, {"precise": 1}, "precise")
    stats = {r.comp: (r.files, r.symbols, r.exported, r.fan_in, r.fan_out) for r in view.components(s, e).collect()}
    assert stats == {ORDERS: (2, 2, 1, 0, 1), STOCK: (1, 1, 1, 1, 1), LEDGER: (1, 1, 1, 1, 0)}
    assert view.excluded_tests(s).first().test_files == 1
    assert view.tier_summary(view.induced(crossed, 0)).first().asDict() == {"precise": 1, "measured": 2, "structural": 0, "heuristic": 1}


def test_order_of_rows_does_not_matter(spark):
    s, e = graph_of(spark)
    a = view.induced(view.crossings(s, e)).collect()
    b = view.induced(view.crossings(s.orderBy(F.desc("id")), e.orderBy(F.rand(3)))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_site_cap_keeps_weight(spark):
    s, e = graph_of(spark)
    got = view.induced(view.crossings(s, e), 1).where(f"src_comp = '{ORDERS}'").first()
    assert (got.weight, len(got.sites)) == (3, 1)
    assert view.expand(view.crossings(s, e), ORDERS, STOCK).count() == 3


def test_repeated_evidence_counts(spark):
    s, e = graph_of(spark)
    many = e.where("src = 'hold'").crossJoin(spark.range(40)).drop("id")
    got = view.induced(view.crossings(s, e.unionByName(many)), 5).where(f"src_comp = '{STOCK}'").first()
    assert (got.weight, len(got.sites)) == (41, 5)


def test_depth_joins_folders(spark):
    s, e = graph_of(spark)
    assert {r.comp for r in view.components(s, e, 1).collect()} == {"shop"} and view.crossings(s, e, 1).count() == 0
    assert view.components(s.withColumn("file_path", F.lit("one.py")), e).first().comp == "(root)"


def test_cycles(spark):
    pairs = lambda text: spark.createDataFrame([p.split(">") for p in text.split()], "src_comp string, dst_comp string")
    assert view.cycles(pairs("k>l l>m k>m")).count() == 0
    ring = pairs("m>n n>o o>l l>m a>m o>z")
    found = view.cycles(ring)
    assert sorted(map(tuple, found.collect())) == [(c, "l") for c in "lmno"] and view.cycle_edges(ring, found).count() == 4
    assert sorted(map(tuple, view.cycles(pairs("b>c c>b c>d d>e e>d")).collect())) == [("b", "b"), ("c", "b"), ("d", "d"), ("e", "d")]


def test_rules(spark):
    assert view.parse_rules([" a/* -> b # c ", "x->y"]) == [view.Rule("a/* -> b", "a/*", "b"), view.Rule("x->y", "x", "y")]
    with pytest.raises(ValueError, match="'a ->', 'nothing', '# -> b'"):
        view.parse_rules(["a -> b", "a ->", "nothing", "# -> b"])
    s, e = graph_of(spark)
    edges = view.induced(view.crossings(s, e), 0)
    got = view.violations(spark, edges, view.parse_rules([f"{ORDERS} -> *", f"{STOCK} -> {LEDGER}", f"{LEDGER} -> {ORDERS}", "shop/?t* -> shop/*"]))
    assert sorted((r.rule, r.src_comp, r.dst_comp) for r in got.collect()) == [("shop/?t* -> shop/*", STOCK, LEDGER), (f"{ORDERS} -> *", ORDERS, STOCK), (f"{STOCK} -> {LEDGER}", STOCK, LEDGER)]
    verdict = lambda rules, strict=False: view.rules_verdict(view.violations(spark, edges, view.parse_rules(rules)), strict).first().verdict
    assert [verdict([f"{LEDGER} -> *"]), verdict([f"{ORDERS} -> *"]), verdict([f"{ORDERS} -> *"], True), verdict([f"{STOCK} -> *"])] == ["pass", "review", "fail", "fail"]
