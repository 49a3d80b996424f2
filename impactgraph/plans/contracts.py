"""Queries on contracts: types, their members and callers, derived from nations, suppliers, customers and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.operators import context, graph, lookup, verify
from impactgraph.plans.catalog import query
from impactgraph.sources import adapters as A


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Nations are types, suppliers methods of their nation's, customers functions."""
    n, s, c = (A.table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    row = lambda d, id_, name, parent, params, kind, path, start, abstract: d.select(
        id_.alias("id"), name.alias("name"), name.alias("qualified_name"), parent.alias("parent"), params.alias("params"), kind.alias("kind"), path.alias("file_path"),
        start.cast("int").alias("start"), (start + 4).cast("int").alias("end"), abstract.alias("abstract"), (start % 3 == 1).alias("exports"), (start % 5 == 1).alias("other_calls"),
    )
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    key, home = F.col("s_suppkey"), F.col("s_nationkey")
    types = row(n, text("t:", F.col("n_nationkey")), F.col("n_name"), F.lit(""), F.lit(""), F.when(F.col("n_nationkey") < 5, "interface").otherwise("class"), text("src/", F.col("n_name"), ".java"), F.lit(1), F.col("n_nationkey") % 4 == 0)
    members = row(s, text("s:", key), text("op", key % 6), text("t:", home), F.when(key % 2 == 0, "int a").otherwise("str b"), F.lit("method"), text("src/t", home, ".java"), key * 10, F.lit(False))
    functions = row(c, text("c:", F.col("c_custkey")), F.col("c_name"), F.lit(""), F.lit(""), F.lit("function"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "app/test/home.java").otherwise(text("app/", F.col("c_mktsegment"), ".java")), F.col("c_custkey") * 10, F.lit(False))
    return types.unionByName(members).unionByName(functions)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of all order lines that were returned, each pair once; a type extends the one five before it, and some one unknown."""
    line, order = A.table(spark, sf, "lineitem").where("l_returnflag = 'A'"), A.table(spark, sf, "orders")
    calls = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.concat(F.lit("s:"), "l_suppkey").alias("dst"), F.lit("calls").alias("type"), F.lit(1.0).alias("confidence")).distinct()
    n = F.col("n_nationkey")
    up = A.table(spark, sf, "nation").select(F.concat(F.lit("t:"), n).alias("src"), F.explode(F.filter(F.array(F.when(n >= 5, F.concat(F.lit("t:"), n - 5)), F.when(n % 7 == 3, F.lit("ext:1"))), lambda x: x.isNotNull())).alias("dst"), n.alias("n"))
    up = up.select("src", "dst", F.when(F.col("n") < 10, F.when(F.col("dst") == "ext:1", "extends").otherwise("implements")).otherwise("extends").alias("type"), F.lit(1.0).alias("confidence"))
    return calls.unionByName(up)


_TABLES = """WITH RECURSIVE symbols AS (
        SELECT 't:' || n_nationkey AS id, n_name AS name, '' AS parent, '' AS params, CASE WHEN n_nationkey < 5 THEN 'interface' ELSE 'class' END AS kind, 'src/' || n_name || '.java' AS file_path, 1 AS "start", 5 AS "end", n_nationkey % 4 = 0 AS abstract, TRUE AS exports, TRUE AS other_calls FROM nation
        UNION ALL SELECT 's:' || s_suppkey, 'op' || (s_suppkey % 6), 't:' || s_nationkey, CASE s_suppkey % 2 WHEN 0 THEN 'int a' ELSE 'str b' END, 'method', 'src/t' || s_nationkey || '.java', s_suppkey * 10, s_suppkey * 10 + 4, FALSE, s_suppkey * 10 % 3 = 1, s_suppkey * 10 % 5 = 1 FROM supplier
        UNION ALL SELECT 'c:' || c_custkey, c_name, '', '', 'function', CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'app/test/home.java' ELSE 'app/' || c_mktsegment || '.java' END, c_custkey * 10, c_custkey * 10 + 4, FALSE, c_custkey * 10 % 3 = 1, c_custkey * 10 % 5 = 1 FROM customer),
    calls AS (SELECT DISTINCT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
    up AS (SELECT 't:' || n_nationkey AS src, 't:' || (n_nationkey - 5) AS dst, CASE WHEN n_nationkey < 10 THEN 'implements' ELSE 'extends' END AS type FROM nation WHERE n_nationkey >= 5
        UNION ALL SELECT 't:' || n_nationkey, 'ext:1', 'extends' FROM nation WHERE n_nationkey % 7 = 3), """

#: The change of NATION_7's op2, as SQL: roles of symbols.
_CHANGE = _TABLES + """own AS (SELECT id FROM symbols WHERE name = 'NATION_7' AND kind IN ('class', 'interface')),
    above AS (SELECT id, 0 AS d FROM own UNION ALL SELECT up.dst, d + 1 FROM above JOIN up ON up.src = above.id),
    every AS (SELECT id FROM above UNION SELECT up.src FROM every JOIN up ON up.dst = every.id),
    roles AS (SELECT s.id, CASE WHEN a.d = 0 THEN 'declaration' WHEN a.d > 0 THEN 'super' ELSE 'family' END AS role FROM symbols s JOIN (SELECT DISTINCT id FROM every) e ON s.parent = e.id LEFT JOIN (SELECT id, min(d) AS d FROM above GROUP BY id) a ON a.id = s.parent WHERE s.name = 'op2'),
    change AS (SELECT id, role FROM roles UNION ALL SELECT DISTINCT src, 'caller' FROM calls WHERE dst IN (SELECT id FROM roles) AND src NOT IN (SELECT id FROM roles)
        UNION ALL SELECT DISTINCT parent, 'declaring_type' FROM symbols JOIN roles USING (id) WHERE role <> 'super' AND parent <> ''),
    found AS (SELECT change.id, role, file_path, name, "start", "end", other_calls FROM change JOIN symbols USING (id)) """


def _change(spark, sf):
    return graph.change_impact(symbols(spark, sf), edges(spark, sf), "NATION_7", "op2")


@query(_CHANGE + 'SELECT id, role, file_path, name, "start" FROM found')
def change_impact_roles(spark, sf):
    return _change(spark, sf).select("id", "role", "file_path", "name", F.col("start").cast("long").alias("start"))


@query(_CHANGE + """SELECT count(*) FILTER (role <> 'super') AS total_sites, CASE WHEN EXISTS (SELECT 1 FROM up JOIN found ON up.src = found.id AND role = 'declaring_type' WHERE up.dst NOT IN (SELECT id FROM symbols)) THEN 'project-local' ELSE 'closed' END AS completeness FROM found""")
def change_total_sites(spark, sf):
    found = graph.cut_lineage(_change(spark, sf))
    return graph.total_sites(found).crossJoin(graph.completeness(symbols(spark, sf), edges(spark, sf), found))


@query(_CHANGE + """SELECT role, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 10), ' ') AS names FROM found GROUP BY role""")
def change_summary(spark, sf):
    return context.result_summary(_change(spark, sf)).select("role", "n", F.array_join("names", " ").alias("names"))


@query(_CHANGE + """, n AS (SELECT count(*) FILTER (role = 'family') AS family, count(*) FILTER (role = 'caller') AS callers FROM found)
    SELECT family, callers, (SELECT string_agg(name, ' ') FROM (SELECT name FROM found WHERE role = 'caller' ORDER BY name LIMIT 3)) AS first_callers FROM n WHERE family > 0 OR callers >= 2""")
def change_note(spark, sf):
    return context.structural_note(_change(spark, sf), 1).select("family", "callers", F.array_join("first_callers", " ").alias("first_callers"))


@query(_TABLES + """root AS (SELECT id FROM symbols WHERE name = 'NATION_2' AND kind IN ('interface', 'class')),
    below AS (SELECT id FROM root UNION SELECT up.src FROM below JOIN up ON up.dst = below.id),
    has AS (SELECT DISTINCT parent AS id, TRUE AS own FROM symbols WHERE name = 'op3' AND parent <> ''),
    inh AS (SELECT id FROM has UNION SELECT up.src FROM inh JOIN up ON up.dst = inh.id AND up.type = 'extends'),
    loose AS (SELECT src AS id FROM up WHERE type = 'extends' AND dst NOT IN (SELECT id FROM symbols) UNION SELECT up.src FROM loose JOIN up ON up.dst = loose.id AND up.type = 'extends')
    SELECT s.id, s.name, s.file_path, CASE WHEN s.id IN (SELECT id FROM has) THEN 'implemented' WHEN s.id IN (SELECT id FROM inh) THEN 'inherited' WHEN s.id IN (SELECT id FROM loose) THEN 'unverifiable' WHEN abstract THEN 'abstract_missing' ELSE 'missing' END AS status
    FROM symbols s WHERE id IN (SELECT id FROM below) AND id NOT IN (SELECT id FROM root)""")
def missing_members(spark, sf):
    return graph.missing_implementations(symbols(spark, sf), edges(spark, sf), "NATION_2", "op3")


@query(_CHANGE + r""", lines AS (SELECT file_path AS file, "start" + 1 AS line, 'x = ' || CASE WHEN "start" % 40 = 0 THEN 'other' ELSE name END || '(1);' AS text FROM symbols WHERE kind = 'method')
    SELECT DISTINCT f.file_path AS file, coalesce(l.line, 0) AS line, l.text AS before, regexp_replace(l.text, '\bop2\b', 'renamed', 'g') AS after, CASE WHEN l.line IS NULL THEN 'unresolved' WHEN other_calls THEN 'ambiguous' ELSE 'edit' END AS class
    FROM found f LEFT JOIN lines l ON l.file = f.file_path AND l.line BETWEEN f."start" AND f."end" AND regexp_matches(l.text, '\bop2\b') WHERE role <> 'declaring_type'""")
def rename_edits(spark, sf):
    s = symbols(spark, sf)
    called = F.when(F.col("start") % 40 == 0, "other").otherwise(F.col("name"))
    lines = s.where("kind = 'method'").select(F.col("file_path").alias("file"), (F.col("start") + 1).alias("line"), F.concat(F.lit("x = "), called, F.lit("(1);")).alias("text"))
    got = graph.rename_plan(_change(spark, sf), lines, s, "op2", "renamed")
    return got.withColumn("line", F.coalesce(F.col("line").cast("long"), F.lit(0)))


@query(_TABLES + """code AS (SELECT * FROM symbols WHERE kind IN ('function', 'method')),
    live AS (SELECT id FROM code WHERE exports OR file_path LIKE '%/test/%' UNION SELECT dst FROM live JOIN calls ON src = id),
    words AS (SELECT name, count(*) AS n FROM symbols WHERE kind = 'function' GROUP BY name)
    SELECT id, 'dead' AS status FROM code LEFT JOIN words USING (name) WHERE id NOT IN (SELECT id FROM live) AND coalesce(n, 0) <= 1
    UNION ALL SELECT id, 'exported_unreferenced' FROM code WHERE exports AND id NOT IN (SELECT dst FROM calls UNION SELECT dst FROM up)""")
def dead_code_status(spark, sf):
    s = symbols(spark, sf)
    return graph.dead_code(s, edges(spark, sf), s.where("kind = 'function'").groupBy(F.col("name").alias("word")).agg(F.count("*").alias("n")))


@query(_TABLES + """sizes AS (SELECT s.id, name AS leaf, count(src) AS sites, "start" % 30 <> 0 AS closed, "start" % 110 = 0 AS double_, "start" AS pos FROM symbols s LEFT JOIN calls ON dst = s.id WHERE kind = 'method' GROUP BY ALL),
    own AS (SELECT leaf, sites AS own FROM sizes WHERE id = 's:7'),
    r AS (SELECT *, row_number() OVER (ORDER BY pos) AS rank FROM sizes JOIN own USING (leaf) WHERE id <> 's:7' AND NOT double_)
    SELECT id, sites, own FROM r WHERE rank <= 8 AND closed AND sites > own AND (SELECT count(*) FROM sizes JOIN own USING (leaf)) >= 3 ORDER BY sites DESC, pos LIMIT 1""")
def wider_anchor(spark, sf):
    s = symbols(spark, sf).where("kind = 'method'")
    sites = edges(spark, sf).where("type = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("sites"))
    sizes = s.join(sites, "id", "left").select("id", F.col("name").alias("leaf"), F.coalesce("sites", F.lit(0)).cast("long").alias("sites"), (F.col("start") % 30 != 0).alias("closed"), (F.col("start") % 110 == 0).alias("test_double"), F.col("start").alias("pos"))
    return graph.wider_anchor(sizes, "s:7")


@query(_TABLES + """hit AS (SELECT DISTINCT src AS id FROM calls WHERE dst IN (SELECT id FROM symbols WHERE name = 'op1')) SELECT id, file_path, name, 'caller' AS role FROM hit JOIN symbols USING (id)""")
def impact_fallback(spark, sf):
    got = context.change_impact_or_callers(symbols(spark, sf), edges(spark, sf), [("NATION_1", "nothing"), ("Unknown", "op1")])
    return got.select("id", "file_path", "name", "role")


_SEEDS = """seeds AS (SELECT * FROM (VALUES ('op1', 'int x'), ('op4', 'int b, str c'), ('op5', 'T b')) t(name, params)),
    family AS (SELECT s.name AS seed, s.id FROM symbols s JOIN seeds ON s.name = seeds.name WHERE s.kind IN ('function', 'method', 'constructor') AND (seeds.name = 'op5' OR (seeds.name = 'op1' AND s.params LIKE 'int %'))),
    probed AS (SELECT seed, family.id FROM family JOIN symbols USING (id) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY file_path, "start") <= 60),
    surv AS (SELECT seed, id FROM family UNION SELECT seed, src FROM probed JOIN calls ON dst = id) """


def _survivors(spark, sf):
    seed = spark.createDataFrame([("op1", "int x", "java"), ("op4", "int b, str c", "java"), ("op5", "T b", "java")], "name string, params string, language string")
    return verify.survivors(symbols(spark, sf), edges(spark, sf), seed)


@query(_TABLES + _SEEDS + """SELECT seed, surv.id AS symbol, file_path AS file FROM surv JOIN symbols USING (id)""")
def contract_survivors(spark, sf):
    return _survivors(spark, sf).select("seed", "symbol", "file")


@query(_CHANGE + ", " + _SEEDS + """, test AS (SELECT *, file_path LIKE '%/test/%' OR file_path LIKE '%/tests/%' AS is_test FROM symbols)
    SELECT DISTINCT * FROM (SELECT 'op2' AS seed, f.id AS symbol, f.file_path AS file FROM found f JOIN test USING (id) WHERE role <> 'super' AND NOT is_test UNION ALL SELECT seed, id, file_path FROM surv JOIN test USING (id) WHERE NOT is_test)""")
def required_set(spark, sf):
    place = [F.lit("src/t7.java").alias("seed_file"), F.lit(0).alias("seed_start")]
    own = _change(spark, sf).join(symbols(spark, sf).select("id", "end"), "id").select(F.lit("op2").alias("seed"), *place, F.col("id").alias("symbol"), F.col("file_path").alias("file"), "start", "end", "role")
    rest = _survivors(spark, sf).select("seed", *place, "symbol", "file", "start", "end")
    return verify.required_set(own, rest).select("seed", "symbol", "file")


@query(_CHANGE + ", " + _SEEDS + """, req AS (SELECT DISTINCT * FROM (SELECT 'op2' AS seed, id AS symbol, file_path AS file, "start", "end" FROM found WHERE role <> 'super' UNION ALL SELECT seed, id, file_path, "start", "end" FROM surv JOIN symbols USING (id))
        WHERE NOT (file LIKE '%/test/%') AND NOT (file = 'src/t7.java' AND "start" = 70)),
    ch AS (SELECT file_path AS file, "start" AS s, "start" + 1 AS e FROM symbols WHERE "start" % 70 = 0),
    sites AS (SELECT r.symbol, r.seed, r.file, r."start" + 1 + (s.name = 'op5')::INT AS line FROM req r JOIN calls c ON c.src = r.symbol JOIN symbols s ON s.id = c.dst WHERE s.name = r.seed AND s.name <> 'op1'),
    miss AS (SELECT * FROM sites WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.file = sites.file AND line BETWEEN s AND e)
        UNION ALL SELECT symbol, seed, file, "start" FROM req r WHERE NOT EXISTS (SELECT 1 FROM sites WHERE sites.symbol = r.symbol AND sites.seed = r.seed) AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.file = r.file AND r."start" <= e AND r."end" >= s))
    SELECT DISTINCT seed, file, line FROM miss""")
def missed_by_seeds(spark, sf):
    """Missed sites of three seeds: their own declaration isn't asked about, and two seeds missed at one line are two rows."""
    s, e = symbols(spark, sf), edges(spark, sf)
    place = [F.lit("src/t7.java").alias("seed_file"), F.lit(70).alias("seed_start")]
    own = _change(spark, sf).join(s.select("id", "end"), "id").select(F.lit("op2").alias("seed"), *place, F.col("id").alias("symbol"), F.col("file_path").alias("file"), "start", "end", "role")
    required = verify.required_set(own, _survivors(spark, sf).select("seed", *place, "symbol", "file", "start", "end"))
    named = s.select(F.col("id").alias("dst"), F.col("name").alias("callee")).where("callee <> 'op1'")
    calls = e.where("type = 'calls'").join(named, "dst").join(s.select(F.col("id").alias("src"), "start"), "src").select(F.col("src").alias("symbol"), "callee", (F.col("start") + 1 + (F.col("callee") == "op5").cast("int")).alias("line"))
    changed = s.where("start % 70 = 0").select(F.col("file_path").alias("file"), "start", (F.col("start") + 1).alias("end"))
    return verify.missed(required, calls, changed).select("seed", "file", F.col("line").cast("long").alias("line"))


@query(_TABLES + """n AS (SELECT src AS seed, dst AS neighbor FROM calls UNION ALL SELECT dst, src FROM calls) SELECT seed, neighbor FROM n JOIN symbols ON symbols.id = neighbor WHERE seed IN ('c:7', 's:3')""")
def call_neighbors(spark, sf):
    s = symbols(spark, sf)
    return graph.call_neighbors(edges(spark, sf), s, s.where("id IN ('c:7', 's:3')").select("id")).select("seed", "neighbor")


@query("""SELECT DISTINCT 'seg/' || c_mktsegment AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_suppkey % 10 = 3""")
def file_dependents(spark, sf):
    line = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(A.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = line.select(F.concat(F.lit("seg/"), "c_mktsegment", F.lit("::f"), "c_custkey").alias("src"), F.concat(F.lit("part/"), F.col("l_suppkey") % 10, F.lit("::g"), "l_suppkey").alias("dst"))
    return graph.dependents(e, "part/3")


@query(_TABLES + """r AS (SELECT id, CASE WHEN name = 'op2' THEN 0 ELSE 1 END AS rank FROM symbols WHERE name = 'op2') SELECT id, rank FROM r""")
def name_resolution(spark, sf):
    return lookup.resolve(symbols(spark, sf), "op2").select("id", "rank")


@query(_TABLES + """view_ AS (SELECT 'symbol' AS section, id, file_path, kind AS detail FROM symbols WHERE id = 't:12'
        UNION ALL SELECT 'edge', u.dst, s.file_path, u.type || ' out' FROM up u JOIN symbols s ON s.id = u.dst WHERE u.src = 't:12' UNION ALL SELECT 'edge', u.src, s.file_path, u.type || ' in' FROM up u JOIN symbols s ON s.id = u.src WHERE u.dst = 't:12') SELECT * FROM view_""")
def node_view(spark, sf):
    return context.node_view(symbols(spark, sf), edges(spark, sf), "NATION_12")


@query(_TABLES + """x AS (SELECT 1) SELECT id, kind, name FROM symbols WHERE file_path = 'src/t7.java'""")
def file_symbols(spark, sf):
    return context.file_symbols(symbols(spark, sf), "src/t7.java").select("id", "kind", "name")
