"""Queries on many seeds at once: change sets, required sites, families of overloads, wider anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.operators import graph, impacts, verify
from impactgraph.plans.catalog import query
from impactgraph.plans.contracts import _TABLES, edges, symbols
from impactgraph.sources import adapters as A


def _first_members(spark: SparkSession, sf: str) -> DataFrame:
    """The first member of each type and name."""
    s = symbols(spark, sf).where("kind = 'method'")
    return s.groupBy("parent", "name").agg(F.min_by(F.struct("id", "file_path", "start"), "start").alias("x")).select("parent", "name", "x.*")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Every type's six members, with and without parameters; the places of first members; every function; and names that
    are unknown, ambiguous, null or empty."""
    member = A.table(spark, sf, "nation").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.concat("n_name", F.lit(".op"), j))).alias("seed"))
    place = _first_members(spark, sf).select(F.concat("file_path", F.lit(":"), F.col("start") + 2).alias("seed"))
    odd = spark.createDataFrame([("op1",), ("nothing",), ("Nowhere.op1",), ("src/t7.java:7",), ("",), (None,), ("a(b",)], "seed string")
    return member.union(member.select(F.concat("seed", F.lit("(int a)")))).union(place).union(A.table(spark, sf, "customer").select("c_name")).union(odd)


_MANY = _TABLES + """first_ AS (SELECT parent, name, min("start") AS "start", min_by(id, "start") AS id, min_by(params, "start") AS params, any_value(file_path) AS file_path FROM symbols WHERE kind = 'method' GROUP BY parent, name),
    named AS (SELECT id AS type_id, name AS type_name FROM symbols WHERE kind IN ('class', 'interface')),
    typed AS (SELECT type_name || '.op' || j AS seed, type_id, 'op' || j AS member, NULL AS params FROM named, range(6) t(j)
        UNION ALL SELECT type_name || '.op' || j || '(int a)', type_id, 'op' || j, 'int a' FROM named, range(6) t(j)
        UNION ALL SELECT file_path || ':' || ("start" + 2), parent, name, params FROM first_),
    above AS (SELECT type_id AS root, type_id AS id, 0 AS d FROM named UNION ALL SELECT root, up.dst, d + 1 FROM above JOIN up ON up.src = above.id),
    every AS (SELECT root, id FROM above UNION SELECT root, up.src FROM every JOIN up ON up.dst = every.id),
    near AS (SELECT root, id, min(d) AS d FROM above GROUP BY ALL),
    roles AS (SELECT t.seed, s.id, s.parent, CASE WHEN n.d = 0 THEN 'declaration' WHEN n.d > 0 THEN 'super' ELSE 'family' END AS role
        FROM typed t JOIN every e ON e.root = t.type_id JOIN symbols s ON s.parent = e.id AND s.name = t.member AND (t.params IS NULL OR s.params = t.params) LEFT JOIN near n ON n.root = t.type_id AND n.id = s.parent
        UNION ALL SELECT name, id, '', 'declaration' FROM symbols WHERE kind = 'function'),
    found AS (SELECT seed, role, id FROM roles
        UNION ALL SELECT DISTINCT r.seed, 'caller', c.src FROM roles r JOIN calls c ON c.dst = r.id WHERE NOT EXISTS (SELECT 1 FROM roles o WHERE o.seed = r.seed AND o.id = c.src)
        UNION ALL SELECT DISTINCT seed, 'declaring_type', parent FROM roles WHERE role <> 'super' AND parent <> '') """


@query(_MANY + "SELECT seed, role, id FROM found")
def impact_many(spark, sf):
    return impacts.impacts(symbols(spark, sf), edges(spark, sf), _seeds(spark, sf))[0]


@query(_MANY + """, states AS (SELECT seed, CASE WHEN EXISTS (SELECT 1 FROM found f JOIN up ON up.src = f.id WHERE f.seed = s.seed AND role = 'declaring_type' AND up.dst NOT IN (SELECT id FROM symbols)) THEN 'project-local' ELSE 'closed' END AS completeness FROM (SELECT DISTINCT seed FROM roles) s),
    asked AS (SELECT DISTINCT seed FROM typed UNION SELECT name FROM symbols WHERE kind = 'function' UNION SELECT * FROM (VALUES ('op1'), ('nothing'), ('Nowhere.op1'), ('src/t7.java:7'), (''), ('a(b')) t(seed))
    SELECT seed, CASE WHEN completeness IS NOT NULL THEN 'resolved' WHEN seed = 'op1' THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN seed = 'op1' THEN 'callers-only' ELSE completeness END AS completeness FROM asked LEFT JOIN states USING (seed)""")
def impact_states(spark, sf):
    return impacts.impacts(symbols(spark, sf), edges(spark, sf), _seeds(spark, sf), callers_only=True)[1]


@query(_MANY + """, req AS (SELECT DISTINCT f.name AS seed, f.file_path AS seed_file, f."start" AS seed_start, s.id AS symbol, s.file_path AS file
        FROM first_ f JOIN named n ON n.type_id = f.parent JOIN found ON found.seed = n.type_name || '.' || f.name JOIN symbols s ON s.id = found.id WHERE role IN ('family', 'caller', 'declaring_type') AND s.file_path NOT LIKE '%/test/%')
    SELECT seed, seed_file, seed_start, symbol, file FROM req""")
def required_many(spark, sf):
    """What the first member of each type and name asks to be touched when all of them change."""
    s = symbols(spark, sf)
    changed = _first_members(spark, sf).join(s.select(F.col("id").alias("parent"), F.col("name").alias("parent_name")), "parent").withColumn("qualified_name", F.lit(""))
    got = impacts.required_many(s, edges(spark, sf), changed)[0]
    return got.select("seed", "seed_file", F.col("seed_start").cast("long").alias("seed_start"), "symbol", "file")


_REACH = """WITH RECURSIVE e AS (SELECT DISTINCT 'c:' || o_custkey AS src, 'p:' || (l_partkey % 97) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT DISTINCT 'p:' || (p_partkey % 97), 'p:' || (p_partkey % 97 + 1 + p_partkey % 3) FROM part WHERE p_partkey % 97 < 90),
    seeds AS (SELECT DISTINCT 'p:' || (p_partkey % 97) AS id FROM part UNION SELECT 'nobody'),
    r AS (SELECT id AS seed, id, 0 AS depth FROM seeds UNION SELECT seed, e.src, depth + 1 FROM r JOIN e ON e.dst = r.id WHERE depth < 3)
    SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id"""


@query(_REACH)
def reach_many(spark, sf):
    """What reaches each of 97 stations of a line within three steps, and who buys there: two groups of bits."""
    bought = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.concat(F.lit("p:"), F.col("l_partkey") % 97).alias("dst"))
    part, at = A.table(spark, sf, "part"), F.col("p_partkey") % 97
    line = part.where(at < 90).select(F.concat(F.lit("p:"), at).alias("src"), F.concat(F.lit("p:"), at + 1 + F.col("p_partkey") % 3).alias("dst"))
    seeds = part.select(F.concat(F.lit("p:"), at).alias("id")).union(spark.createDataFrame([("nobody",)], "id string")).distinct()
    return impacts.reach_many(bought.union(line), seeds.select(F.col("id").alias("seed"), "id"), 3, reverse=True)


# Overloads: parts are methods m0 to m6 with eight parameter lists, and customers call them.
LISTS = ["Map<K, V> m, int a", "Map<String, V> x, int b", "String s, int c", "TKey k, long z", "T t", "f(int, int) g, int c", "", "int q"]


def overloads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges)."""
    p, c = A.table(spark, sf, "part"), A.table(spark, sf, "customer")
    key = F.col("p_partkey")
    lists = F.array(*map(F.lit, LISTS))
    shape = lambda d, id_, name, kind, params, path, start: d.select(id_.alias("id"), name.alias("name"), F.lit(kind).alias("kind"), params.alias("params"), path.alias("file_path"), start.cast("int").alias("start"), (start + 4).cast("int").alias("end"))
    s = shape(p, F.concat(F.lit("p:"), key), F.concat(F.lit("m"), key % 7), "method", lists[(key % 8).cast("int")], F.concat(F.lit("lib/"), "p_brand", F.lit(".java")), key * 10)
    s = s.union(shape(c, F.concat(F.lit("c:"), "c_custkey"), F.col("c_name"), "function", F.lit(""), F.concat(F.lit("app/"), "c_mktsegment", F.lit(".java")), F.col("c_custkey") * 10))
    line = A.table(spark, sf, "lineitem").where("l_returnflag = 'A'").join(A.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return s, line.select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"), F.lit("calls").alias("type")).distinct()


def _contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Base sides: one by the rule of single capitals, one of declared variables, a class named T, and the rest."""
    rows = [("m0", "Map<K, V> old, int n", "java", [], None), ("m1", "TKey a, long b", "java", ["TKey"], "TKey a"), ("m2", "T a", "java", ["TKey"], None), ("m3", "T a", "java", [], None), ("m4", "int x", "java", [], "int x"), ("m5", "", "java", [], "int x"), ("m6", "T t", "python", ["X"], None)]
    seeds = spark.createDataFrame(rows, "name string, params string, language string, type_parameters array<string>, new_params string")
    own = A.table(spark, sf, "part").where("p_partkey = 56").select(F.lit("m0").alias("name"), F.concat(F.lit("lib/"), "p_brand", F.lit(".java")).alias("file_path"), (F.col("p_partkey") * 10).alias("start"))
    return seeds.join(F.broadcast(own), "name", "left")


_OVERLOADS = """WITH symbols AS (SELECT 'p:' || p_partkey AS id, 'm' || (p_partkey % 7) AS name, 'method' AS kind, p_partkey % 8 AS list, 'lib/' || p_brand || '.java' AS file_path, p_partkey * 10 AS "start", p_partkey FROM part
        UNION ALL SELECT 'c:' || c_custkey, c_name, 'function', 6, 'app/' || c_mktsegment || '.java', c_custkey * 10, NULL FROM customer),
    calls AS (SELECT DISTINCT 'c:' || o_custkey AS src, 'p:' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
    lp AS (SELECT * FROM (VALUES (0, 2, 1, 'Map<K, V>'), (0, 2, 2, 'int'), (1, 2, 1, 'Map<String, V>'), (1, 2, 2, 'int'), (2, 2, 1, 'String'), (2, 2, 2, 'int'), (3, 2, 1, 'TKey'), (3, 2, 2, 'long'), (4, 1, 1, 'T'), (5, 2, 1, 'f(int, int)'), (5, 2, 2, 'int'), (7, 1, 1, 'int')) t(list, arity, pos, type)),
    sp AS (SELECT * FROM (VALUES ('m0', 2, 1, 'Map<K, V>', TRUE), ('m0', 2, 2, 'int', FALSE), ('m1', 2, 1, 'TKey', TRUE), ('m1', 2, 2, 'long', FALSE), ('m2', 1, 1, 'T', FALSE), ('m3', 1, 1, 'T', TRUE)) t(seed, arity, pos, type, free)),
    fits AS (SELECT seed, list FROM sp JOIN lp USING (arity, pos) WHERE free OR sp.type = lp.type GROUP BY seed, list, arity HAVING count(*) = arity UNION ALL SELECT 'm6', 4),
    family AS (SELECT seed, id, file_path, "start" FROM symbols JOIN fits ON fits.seed = symbols.name AND fits.list = symbols.list WHERE kind = 'method' AND p_partkey <> 56) """


@query(_OVERLOADS + "SELECT seed, id FROM family")
def overload_family(spark, sf):
    return verify.base_contract_family(overloads(spark, sf)[0], _contracts(spark, sf)).select("seed", "id")


@query(_OVERLOADS + """, probed AS (SELECT seed, id FROM family QUALIFY row_number() OVER (PARTITION BY seed ORDER BY file_path, "start") <= 60)
    SELECT seed, id AS symbol FROM family UNION SELECT seed, src FROM probed JOIN calls ON dst = id""")
def overload_survivors(spark, sf):
    s, e = overloads(spark, sf)
    return verify.survivors(s, e, _contracts(spark, sf)).select("seed", "symbol")


@query("""WITH calls AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
    sizes AS (SELECT s_suppkey AS id, s_suppkey // 4 AS leaf, count(src) AS sites, s_suppkey % 6 <> 0 AS closed, s_suppkey % 5 = 0 AS double_ FROM supplier LEFT JOIN calls ON dst = s_suppkey GROUP BY ALL),
    enough AS (SELECT leaf FROM sizes GROUP BY leaf HAVING count(*) >= 3),
    pairs AS (SELECT a.id AS seed, b.id, b.sites, a.sites AS own, b.closed, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS probe FROM sizes a JOIN enough USING (leaf) JOIN sizes b USING (leaf) WHERE NOT b.double_ AND a.id <> b.id)
    SELECT 's:' || seed AS seed, 's:' || id AS id, sites, own FROM pairs WHERE probe <= 2 AND closed AND sites > own QUALIFY row_number() OVER (PARTITION BY seed ORDER BY sites DESC, id) = 1""")
def wider_anchors(spark, sf):
    """Every method as a seed among the four of its name, some of them test doubles or open; two are looked at."""
    calls = edges(spark, sf).where("type = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("sites"))
    key = F.col("s_suppkey")
    names = A.table(spark, sf, "supplier").select(F.concat(F.lit("s:"), key).alias("id"), F.floor(key / 4).alias("leaf"), (key % 6 != 0).alias("closed"), (key % 5 == 0).alias("test_double"), key.alias("pos"))
    sizes = names.join(calls, "id", "left").na.fill(0, ["sites"])
    return graph.wider_anchors(sizes, sizes, most=2)
