"""Change sets of many seeds against single runs and against searches one seed at a time."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from impactgraph.operators import graph, impacts

SYMBOLS = "id string, name string, qualified_name string, parent string, params string, kind string, file_path string, start int, end int"


def hierarchy(seed=1, types=40, code=120):
    r = random.Random(seed)
    rows = [(f"t{i}", f"T{i % 37}", "", "", "", r.choice(["class", "interface"]), f"t{i}.java", 1, 400) for i in range(types)]
    for i in range(types):
        rows += [(f"t{i}m{j}", f"op{j}", "", f"t{i}", r.choice(["int a", "str b"]), "method", f"t{i}.java", 10 + 20 * j, 20 + 20 * j) for j in range(3) if r.random() < 0.7]
    rows += [(f"f{i}", f"fun{i % 110}", "", "", r.choice(["", "int a"]), "function", f"f{i}_test.go" if i % 9 == 0 else "f.java", 10 * i + 1, 10 * i + 5) for i in range(code)]
    rows += [("odd", None, None, None, None, "function", None, None, None), ("inner", "inner", "", "", "", "function", "f.java", 2, 3)]
    up = [(f"t{i}", f"t{r.randrange(types)}", r.choice(["extends", "implements"])) for i in range(types) for _ in range(r.randint(0, 2)) if r.random() < 0.6] + [("t3", "ext", "extends")]
    ids = [x[0] for x in rows if x[5] in ("method", "function")]
    calls = [(r.choice(ids), r.choice(ids), "calls") for _ in range(400)]
    return rows, [e for e in up if e[0] != e[1]] + calls


#: A method, and a line inside it.
METHOD = next(x for x in hierarchy()[0] if x[5] == "method")
PLACE = f"{METHOD[6]}:{METHOD[7] + 2}"


@pytest.fixture(scope="module")
def tables(spark):
    rows, edges = hierarchy()
    return spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame(edges, "src string, dst string, type string"), rows, edges


def brute(rows, edges, types, member, params):
    """Roles of one seed whose types are known."""
    above = {t: 0 for t in types}
    todo = list(types)
    while todo:
        at = todo.pop(0)
        for s, d, k in edges:
            if s == at and k != "calls" and d not in above:
                above[d] = above[at] + 1
                todo.append(d)
    every, todo = set(above), list(above)
    while todo:
        at = todo.pop()
        new = {s for s, d, k in edges if d == at and k != "calls"} - every
        every |= new
        todo += new
    out = {}
    for x in rows:
        if x[3] in every and x[1] == member and (params is None or x[4] == params):
            out[x[0]] = "declaration" if above.get(x[3]) == 0 else "super" if x[3] in above else "family"
    return out


def whole(roles, rows, edges):
    known = {x[0] for x in rows}
    parent = {x[0]: x[3] for x in rows}
    got = {(r, i) for i, r in roles.items()}
    got |= {("caller", s) for s, d, k in edges if k == "calls" and d in roles and s not in roles and s in known}
    return got | {("declaring_type", parent[i]) for i, r in roles.items() if r != "super" and parent[i]}


def test_many_seeds_equal_searches_one_by_one(spark, tables):
    symbols, edges, rows, raw = tables
    typed = [(f"T{i}.op{j}{p}", f"T{i}", f"op{j}", {"": None, "(int a)": "int a", "()": ""}[p]) for i in range(37) for j in range(3) for p in ("", "(int a)", "()")]
    seeds = [(x[0],) for x in typed] + [(f"fun{i}",) for i in range(110)] + [("f.java:2",), ("f.java:51",), (PLACE,), ("op1",), ("none",), (None,), ("",), ("pkg.sub.T1.op1",), ("f.java:99999",)]
    found, states = impacts.impacts(symbols, edges, spark.createDataFrame(seeds + seeds[:5], "seed string"))
    got = collections.defaultdict(set)
    for x in found.collect():
        assert (x.role, x.id) not in got[x.seed]
        got[x.seed].add((x.role, x.id))
    state = {x.seed: (x.status, x.completeness) for x in states.collect()}
    assert set(state) == {s or "" for (s,) in seeds}
    outside = {"t3"}
    for text, type_name, member, params in [*typed, ("pkg.sub.T1.op1", "T1", "op1", None)]:
        own = [x[0] for x in rows if x[1] == type_name and x[5] in impacts.TYPES]
        want = whole(brute(rows, raw, own, member, params), rows, raw)
        assert got[text] == want, text
        assert state[text] == (("resolved", "project-local" if ("declaring_type", "t3") in want and outside else "closed") if want else ("unknown", None)), text
    for i in range(110):
        own = [x[0] for x in rows if x[1] == f"fun{i}"]
        assert got[f"fun{i}"] == (whole({own[0]: "declaration"}, rows, raw) if len(own) == 1 else set())
        assert state[f"fun{i}"] == (("resolved", "closed") if len(own) == 1 else ("ambiguous", None))
    assert got["f.java:2"] == whole({"inner": "declaration"}, rows, raw) and ("declaration", "f5") in got["f.java:51"]
    assert got[PLACE] == whole(brute(rows, raw, [METHOD[3]], METHOD[1], METHOD[4]), rows, raw)
    assert state["op1"] == ("ambiguous", None) and state["none"] == state[""] == state["f.java:99999"] == ("unknown", None) and not got["op1"]


def test_one_of_many_is_the_single_run(spark, tables):
    symbols, edges, _, _ = tables
    found, _ = impacts.impacts(symbols, edges, spark.createDataFrame([("T1.op1",), ("T2.op0(int a)",)], "seed string"))
    for seed, args in (("T1.op1", ("T1", "op1")), ("T2.op0(int a)", ("T2", "op0", "int a"))):
        one = graph.change_impact(symbols, edges, *args).where("role <> 'declaring_type'")
        assert {(x.role, x.id) for x in found.where(f"seed = '{seed}' AND role <> 'declaring_type'").collect()} == {(x.role, x.id) for x in one.collect()}


def test_ambiguous_names_have_callers_only(spark, tables):
    symbols, edges, rows, raw = tables
    found, states = impacts.impacts(symbols, edges, spark.createDataFrame([("op1",), ("fun1",), ("T1.op1",)], "seed string"), callers_only=True)
    named = {x[0] for x in rows if x[1] == "op1"}
    assert {(x.role, x.id) for x in found.where("seed = 'op1'").collect()} == {("caller", s) for s, d, k in raw if k == "calls" and d in named}
    assert {x.seed: x.completeness for x in states.collect()}["op1"] == "callers-only"
    assert impacts.impacts(symbols.limit(0), edges, spark.createDataFrame([("op1",)], "seed string"))[0].isEmpty()
    assert impacts.impacts(symbols, edges, spark.createDataFrame([], "seed string"))[1].isEmpty()


def test_required_of_many(spark, tables):
    symbols, edges, rows, raw = tables
    changed = spark.createDataFrame([("t1m1", "op1", "T1.op1", "T1", "t1.java", 30), ("f5", "fun5", "", "", "f.java", 51), ("f1", "fun1", "", None, "f.java", 11), ("gone", "nobody", "", "", "x.java", 1), ("t2m0", "op0", None, "T2", "t2.java", 10)], "id string, name string, qualified_name string, parent_name string, file_path string, start int")
    required, open_ = impacts.required_many(symbols, edges, changed)
    got = collections.defaultdict(set)
    for x in required.collect():
        got[x.seed, x.seed_file].add(x.symbol)
    path = {x[0]: x[6] or "" for x in rows}
    judged = lambda s: {i for r, i in s if r in ("family", "caller", "declaring_type") and "_test" not in path[i]}
    of = lambda t, m: whole(brute(rows, raw, [x[0] for x in rows if x[1] == t and x[5] in impacts.TYPES], m, None), rows, raw)
    assert got["op1", "t1.java"] == judged(of("T1", "op1")) and got["op0", "t2.java"] == judged(of("T2", "op0"))
    named = {x[0] for x in rows if x[1] == "fun1"}
    assert got["fun1", "f.java"] == {s for s, d, k in raw if k == "calls" and d in named and "_test" not in path[s]}
    assert {x.id for x in open_.collect()} == {"gone"} | ({"f5"} if not got["fun5", "f.java"] else set())


def test_reach_of_many_over_two_longs(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)] + [(f"p{i}", f"p{i + 1}") for i in range(25)]
    seeds = [(f"s{i}", f"n{i % 60}") for i in range(130)] + [("s0", "n7"), ("line", "p0"), ("alone", "zzz")]
    got = impacts.reach_many(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "seed string, id string"))
    want = set()
    for s in {x[0] for x in seeds}:
        seen = {i: 0 for k, i in seeds if k == s}
        todo = list(seen)
        while todo:
            at = todo.pop(0)
            for a, b in edges:
                if a == at and b not in seen:
                    seen[b] = seen[at] + 1
                    todo.append(b)
        want |= {(s, i, d) for i, d in seen.items()}
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    two = impacts.reach_many(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "seed string, id string"), 2, reverse=True)
    assert two.agg({"depth": "max"}).first()[0] == 2


def test_few_values_are_not_shuffled_by_their_numbers(spark):
    """A shuffle by number has a task for each value, whose size grows with the table."""
    numbers = impacts.numbered(spark.createDataFrame([("a",), ("b",)], "seed string"), "seed")
    masks = numbers.select("grp").distinct().crossJoin(spark.range(1000)).select("id", "grp", F.lit(1).cast("long").alias("mask"))
    got = impacts.unpacked(masks, numbers)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got.count() == 1000 * numbers.where("bit = 0").count()
