"""Every registered query of the graph and text operators, over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from impactgraph.functions import scalars as S
from impactgraph.operators import graph, lookup, select, session, text, verify, view
from impactgraph.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Search terms of the text queries, and the rules that edges are held against.
TERM, TERMS = "the", ["license", "rights", "tion"]
RULES = ["AFRICA/* -> AMERICA/*  # none may", "ASIA -> EUROPE", "EUROPE/NATION_3 -> *"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_CROSS = A.with_tables("symbols", "edges").rstrip() + """, own AS (SELECT * FROM symbols WHERE NOT test),
    crossed AS (SELECT f.comp AS src_comp, t.comp AS dst_comp, f.region AS src_region, t.region AS dst_region, f.name AS src_symbol, f.file_path AS src_file, f."start" AS src_line,
        t.name AS dst_symbol, t.file_path AS dst_file, t."start" AS dst_line, e.type, e.tier
        FROM edges e JOIN own f ON e.src = f.id JOIN own t ON e.dst = t.id) """  # noqa: E501

_COUNTS = """count(*) AS weight, count(*) FILTER (type = 'calls') AS n_calls, count(*) FILTER (type = 'imports') AS n_imports, count(*) FILTER (type = 'uses-type') AS n_uses_type,
    count(*) FILTER (tier = 'precise') AS n_precise, count(*) FILTER (tier = 'measured') AS n_measured, count(*) FILTER (tier = 'heuristic') AS n_heuristic,
    CASE WHEN count(*) FILTER (tier = 'heuristic') > 0 THEN 'heuristic' WHEN count(*) FILTER (tier = 'measured') > 0 THEN 'measured' ELSE 'precise' END AS min_tier"""

_EDGE_COLUMNS = ("src_comp", "dst_comp", "weight", "n_calls", "n_imports", "n_uses_type", "n_precise", "n_measured", "n_heuristic", "min_tier")


def _crossed(spark: SparkSession, sf: str, depth: int = 0) -> DataFrame:
    return view.crossings(A.symbols(spark, sf), A.edges(spark, sf), depth)


@query(_CROSS + f"SELECT src_comp, dst_comp, {_COUNTS} FROM crossed WHERE src_comp <> dst_comp GROUP BY ALL")
def induced_edges(spark, sf):
    return view.induced(_crossed(spark, sf), 0).select(*_EDGE_COLUMNS)


@query(_CROSS + f"SELECT src_region AS src_comp, dst_region AS dst_comp, {_COUNTS} FROM crossed WHERE src_region <> dst_region GROUP BY ALL")
def induced_edges_by_region(spark, sf):
    return view.induced(_crossed(spark, sf, 1), 0).select(*_EDGE_COLUMNS)


@query(_CROSS + """SELECT src_comp, dst_comp, src_file, src_line, dst_symbol, src_symbol, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY src_comp, dst_comp ORDER BY src_file, src_line, dst_symbol, src_symbol, dst_file, dst_line, type, tier) AS rank FROM crossed WHERE src_comp <> dst_comp) WHERE rank <= 5""")
def induced_sites(spark, sf):
    got = view.induced(_crossed(spark, sf), 5)
    return got.select("src_comp", "dst_comp", F.posexplode("sites").alias("p", "s")).select("src_comp", "dst_comp", "s.src_file", "s.src_line", "s.dst_symbol", "s.src_symbol", (F.col("p") + 1).cast("long").alias("rank"))


@query(_CROSS + """, pairs AS (SELECT DISTINCT src_comp, dst_comp FROM crossed WHERE src_comp <> dst_comp)
    SELECT comp, count(DISTINCT file_path) AS files, count(*) AS symbols, count(*) FILTER (exports) AS exported,
        (SELECT count(*) FROM pairs WHERE dst_comp = comp) AS fan_in, (SELECT count(*) FROM pairs WHERE src_comp = comp) AS fan_out FROM own GROUP BY comp""")
def component_stats(spark, sf):
    return view.components(A.symbols(spark, sf), A.edges(spark, sf))


@query(_CROSS + """SELECT CAST(count(*) FILTER (tier = 'precise') AS BIGINT) AS precise, CAST(count(*) FILTER (tier = 'measured') AS BIGINT) AS measured, 0::BIGINT AS structural, CAST(count(*) FILTER (tier = 'heuristic') AS BIGINT) AS heuristic
    FROM crossed WHERE src_comp <> dst_comp""")
def tier_summary(spark, sf):
    return view.tier_summary(view.induced(_crossed(spark, sf), 0))


_CYCLES = """, pairs AS (SELECT DISTINCT src_comp AS a, dst_comp AS b FROM crossed WHERE src_comp <> dst_comp),
    r AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a),
    members AS (SELECT x.a AS component, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) """


@query(_CROSS + _CYCLES + "SELECT * FROM members")
def cycle_members(spark, sf):
    return view.cycles(_crossed(spark, sf).select("src_comp", "dst_comp").distinct())


@query(_CROSS + _CYCLES + "SELECT a AS src_comp, b AS dst_comp, m.cycle FROM pairs JOIN members m ON a = m.component JOIN members n ON b = n.component WHERE m.cycle = n.cycle")
def cycle_edges(spark, sf):
    pairs = _crossed(spark, sf).select("src_comp", "dst_comp").distinct()
    return view.cycle_edges(pairs, view.cycles(pairs))


@query(_CROSS + f""", ie AS (SELECT src_comp, dst_comp, {_COUNTS} FROM crossed WHERE src_comp <> dst_comp GROUP BY ALL)
    SELECT 'AFRICA/* -> AMERICA/*' AS rule, src_comp, dst_comp, weight, min_tier FROM ie WHERE regexp_full_match(src_comp, 'AFRICA/[^/]*') AND regexp_full_match(dst_comp, 'AMERICA/[^/]*')
    UNION ALL SELECT 'ASIA -> EUROPE', src_comp, dst_comp, weight, min_tier FROM ie WHERE (src_comp = 'ASIA' OR src_comp LIKE 'ASIA/%') AND (dst_comp = 'EUROPE' OR dst_comp LIKE 'EUROPE/%')
    UNION ALL SELECT 'EUROPE/NATION_3 -> *', src_comp, dst_comp, weight, min_tier FROM ie WHERE src_comp = 'EUROPE/NATION_3'""")
def arch_violations(spark, sf):
    found = view.violations(spark, view.induced(_crossed(spark, sf), 0), view.parse_rules(RULES))
    return found.select("rule", "src_comp", "dst_comp", "weight", "min_tier")


@query(_CROSS + "SELECT src_file, src_line, dst_symbol, src_symbol, dst_file, dst_line, type, tier FROM crossed WHERE src_comp = 'AFRICA/NATION_0' AND dst_comp = 'AMERICA/NATION_1'")
def expand_edge(spark, sf):
    return view.expand(_crossed(spark, sf), "AFRICA/NATION_0", "AMERICA/NATION_1")


_COMP_GRAPH = """, pairs AS (SELECT DISTINCT src_comp AS a, dst_comp AS b FROM crossed WHERE src_comp <> dst_comp) """


@query(_CROSS + _COMP_GRAPH + """, r AS (SELECT 'AMERICA/NATION_1' AS id, 0 AS depth UNION SELECT a, depth + 1 FROM r JOIN pairs ON r.id = b WHERE depth < 4)
    SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def reverse_impact_depth(spark, sf):
    pairs = _crossed(spark, sf).select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"))
    return graph.reach(pairs, spark.createDataFrame([("AMERICA/NATION_1",)], "id string"), 4, reverse=True)


@query(A.with_tables("symbols", "edges") + """, live AS (SELECT id FROM symbols WHERE kind = 'function' AND (exports OR test) UNION SELECT dst FROM edges JOIN live ON src = live.id WHERE type = 'calls')
    SELECT id FROM symbols WHERE id NOT IN (SELECT id FROM live)""")
def dead_nodes(spark, sf):
    s = A.symbols(spark, sf)
    roots = s.where((F.col("kind") == "function") & (F.col("exports") | S.is_view_test(F.col("file_path")))).select("id")
    return s.join(graph.reach(A.edges(spark, sf).where("type = 'calls'"), roots), "id", "left_anti").select("id")


_SEEDS = "s:1", "s:2", "c:1", "c:7"


@query(A.with_tables("symbols", "edges") + """, seeds AS (SELECT unnest(['s:1', 's:2', 'c:1', 'c:7']) AS id),
    n AS (SELECT src AS seed, dst AS neighbor, type, 'out' AS direction, confidence FROM edges JOIN seeds ON src = seeds.id UNION ALL SELECT dst, src, type, 'in', confidence FROM edges JOIN seeds ON dst = seeds.id),
    k AS (SELECT n.*, count(*) OVER w AS total, row_number() OVER (PARTITION BY seed, type, direction ORDER BY neighbor, confidence DESC) AS rank FROM n JOIN symbols ON neighbor = symbols.id WINDOW w AS (PARTITION BY seed, type, direction))
    SELECT seed, neighbor, type, direction, round(confidence, 6) AS confidence, total, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 50""")
def neighbors_capped(spark, sf):
    seeds = spark.createDataFrame([(s,) for s in _SEEDS], "id string")
    got = graph.capped_groups(graph.neighbors(A.edges(spark, sf), A.symbols(spark, sf), seeds, kinds=S.EDGE_KINDS))
    return got.select("seed", "neighbor", "type", "direction", F.round("confidence", 6).alias("confidence"), "total", "rank")


@query(A.with_tables("symbols", "edges") + "SELECT dst AS id, count(*) AS callers, count(DISTINCT file_path) AS files FROM edges JOIN symbols ON src = symbols.id WHERE type = 'calls' AND dst IN (SELECT id FROM symbols) GROUP BY dst")
def caller_counts(spark, sf):
    s = A.symbols(spark, sf)
    return graph.callers(A.edges(spark, sf), s, s).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("callers"), F.countDistinct("file_path").alias("files"))


@query(A.with_tables("symbols", "edges") + """SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT file_path) FROM symbols) AS files, (SELECT count(*) FROM edges) AS edges""")
def index_status(spark, sf):
    s = A.symbols(spark, sf).agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))
    return s.crossJoin(A.edges(spark, sf).agg(F.count("*").alias("edges")))


@query(A.with_tables("symbols", "edges") + """, own AS (SELECT id FROM symbols WHERE file_path = 'ASIA/NATION_2/supplier.src') SELECT src, dst, type, count(*) AS n FROM edges WHERE src IN (SELECT id FROM own) OR dst IN (SELECT id FROM own) GROUP BY ALL""")
def file_edges(spark, sf):
    got = graph.file_edges(A.edges(spark, sf), A.symbols(spark, sf), "ASIA/NATION_2/supplier.src")
    return got.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


_HITS = A.with_tables("lines") + f", hits AS (SELECT * FROM lines WHERE contains(lower(text), '{TERM}')) "


@query(_HITS + "SELECT file, line, text FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS rank FROM hits) WHERE rank <= 20 ORDER BY file, line LIMIT 100")
def text_hits(spark, sf):
    return text.capped(text.hits(A.lines(spark, sf), TERM)).select("file", F.col("line").cast("long").alias("line"), "text")


@query(_HITS + "SELECT count(*) AS total_hits, count(DISTINCT file) AS files_matched FROM hits")
def text_totals(spark, sf):
    return text.totals(text.hits(A.lines(spark, sf), TERM))


@query(A.with_tables("lines") + r"""SELECT file, CAST(line AS BIGINT) AS line FROM lines WHERE regexp_matches(text, '(?i)\b(?:licen[sc]e|rights? reserved)\b')""")
def text_regex(spark, sf):
    return text.hits(A.lines(spark, sf), r"licen[sc]e|rights? reserved", regex=True, whole_word=True).select("file", F.col("line").cast("long").alias("line"))


@query(A.with_tables("lines") + """, hits AS (SELECT * FROM lines WHERE contains(lower(text), 'license'))
    SELECT h.file, h.line, h.text, (SELECT coalesce(string_agg(l.text, chr(10) ORDER BY l.line), '') FROM lines l WHERE l.file = h.file AND l.line BETWEEN h.line - 2 AND h.line - 1) AS before,
        (SELECT coalesce(string_agg(l.text, chr(10) ORDER BY l.line), '') FROM lines l WHERE l.file = h.file AND l.line BETWEEN h.line + 1 AND h.line + 2) AS after FROM hits h""")
def text_hits_context(spark, sf):
    lines = A.lines(spark, sf)
    got = text.with_context(lines, text.hits(lines, "license"))
    return got.select("file", F.col("line").cast("long").alias("line"), "text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


_ROLL = A.with_tables("lines", "blocks") + f""", hits AS (SELECT * FROM lines WHERE contains(lower(text), '{TERM}')),
    probed AS (SELECT file FROM hits GROUP BY file ORDER BY count(*) DESC, file LIMIT 20),
    inner_ AS (SELECT h.file, h.line, b.id, row_number() OVER (PARTITION BY h.file, h.line ORDER BY b."end" - b."start", b."start", b.id) AS rank FROM hits h JOIN blocks b ON h.file = b.file AND h.line BETWEEN b."start" AND b."end" WHERE h.file IN (SELECT file FROM probed)),
    counted AS (SELECT file, id AS symbol, count(*) AS hits FROM inner_ WHERE rank = 1 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (ORDER BY hits DESC, file, symbol) AS rank FROM counted) """


@query(_ROLL + """SELECT file, symbol, hits, 'symbol' AS row FROM ranked WHERE rank <= 10
    UNION ALL SELECT '', '+' || count(*) || ' more', CAST(coalesce(sum(hits), 0) AS BIGINT), 'rest' FROM ranked WHERE rank > 10
    UNION ALL SELECT '', '', CAST((SELECT count(*) FROM hits) - (SELECT sum(hits) FROM counted) AS BIGINT), 'outside'""")
def hit_rollup(spark, sf):
    lines = A.lines(spark, sf)
    return text.rollup(text.hits(lines, TERM), A.blocks(lines))


_MULTI = A.with_tables("lines") + """, terms AS (SELECT * FROM (VALUES (0, 'license'), (1, 'rights'), (2, 'tion')) t(pos, term)), found AS (SELECT pos, term, file, line, text FROM lines JOIN terms ON contains(lower(text), term)) """


@query(_MULTI + "SELECT term, file, CAST(line AS BIGINT) AS line, total FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY file, line) AS rank, count(*) OVER (PARTITION BY term) AS total FROM found) WHERE rank <= 40")
def search_multi(spark, sf):
    got = text.multi(A.lines(spark, sf), text.term_list(spark, TERMS))
    return got.select("term", "file", F.col("line").cast("long").alias("line"), "total")


@query(A.with_tables("lines", "blocks") + """, terms AS (SELECT * FROM (VALUES (0, 'license'), (1, 'rights')) t(pos, term)),
    found AS (SELECT DISTINCT file, line FROM lines JOIN terms ON contains(lower(text), term)),
    placed AS (SELECT f.file, f.line, b.id, row_number() OVER (PARTITION BY f.file, f.line ORDER BY b."end" - b."start", b."start", b.id) AS rank FROM found f JOIN blocks b ON f.file = b.file AND f.line BETWEEN b."start" AND b."end"),
    inside AS (SELECT DISTINCT id FROM placed WHERE rank = 1), seeds AS (SELECT id FROM blocks WHERE id LIKE '%::b1')
    SELECT id AS symbol, 'confirmed' AS class FROM seeds WHERE id IN (SELECT id FROM inside) UNION ALL SELECT id, 'promoted' FROM inside WHERE id NOT IN (SELECT id FROM seeds)""")
def merged_seeds(spark, sf):
    lines = A.lines(spark, sf)
    spans = A.blocks(lines)
    terms = text.term_list(spark, TERMS[:2])
    found = text.merged(lines.join(F.broadcast(terms), F.contains(F.lower("text"), F.lower("term"))))
    return text.seeds_from_hits(found.select("file", "line", "text"), spans, spans.where(F.col("id").endswith("::b1")))


@query(A.with_tables("lines") + r"""SELECT file, count(*) AS count, count(DISTINCT line) AS n_lines FROM (
        SELECT file, line, unnest(string_split_regex(regexp_replace(text, '"(?:[^"\\]|\\.)*"', '""', 'g'), '[^\p{L}\p{N}_]+')) AS word FROM lines) WHERE word = 'the' GROUP BY file""")
def reference_counts(spark, sf):
    none = spark.createDataFrame([], "file string, line int, name string")
    return text.references(A.lines(spark, sf), TERM, none).select("file", "count", F.size("lines").cast("long").alias("n_lines"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, CASE WHEN p_type = 'ECONOMY' THEN 'mock/' ELSE 'pkg/' END || p_brand || '.go' AS file_path FROM part),
    s AS (SELECT *, CASE WHEN qualified_name = 'Brand#2.small ring' THEN 1000 WHEN qualified_name = 'small ring' THEN 500 WHEN name = 'small ring' THEN 1 END + CASE WHEN 'mock' = 'Brand#2' OR 'pkg' = 'Brand#2' THEN 100 ELSE 0 END - CASE WHEN file_path LIKE 'mock%' THEN 10 ELSE 0 END AS score FROM p)
    SELECT id, qualified_name, score, dense_rank() OVER (ORDER BY score DESC) AS rank, count(*) FILTER (score = (SELECT max(score) FROM s)) OVER () > 1 AS ambiguous FROM s WHERE score IS NOT NULL""")
def symbol_lookup_rank(spark, sf):
    got = _part_symbols(spark, sf).withColumn("score", lookup.score("Brand#2.small ring")).where("score IS NOT NULL")
    levels = got.select("score").distinct().withColumn("rank", F.dense_rank().over(W.orderBy(F.desc("score"))).cast("long"))
    top = got.groupBy("score").agg(F.count("*").alias("n")).agg((F.max_by("n", "score") > 1).alias("ambiguous"))
    return got.join(F.broadcast(levels), "score").join(F.broadcast(top)).select("id", "qualified_name", "score", "rank", "ambiguous")


def _part_symbols(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.concat(F.when(F.col("p_type") == "ECONOMY", "mock/").otherwise("pkg/"), "p_brand", F.lit(".go")).alias("file_path"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, CASE WHEN p_type = 'ECONOMY' THEN 'mock/' ELSE 'pkg/' END || p_brand || '.go' AS file_path FROM part)
    SELECT id, CASE WHEN lower(name) = 'red' OR lower(qualified_name) = 'red' THEN 0 WHEN lower(name) LIKE 'red%' OR lower(qualified_name) LIKE 'red%' THEN 1 ELSE 2 END AS rank FROM p
    WHERE contains(lower(name), 'red') OR contains(lower(qualified_name), 'red') ORDER BY rank, name, file_path, id LIMIT 25""")
def symbol_search(spark, sf):
    return lookup.search(_part_symbols(spark, sf), "red").select("id", "rank")


@query("""WITH c AS (SELECT role AS tool, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4) END AS o FROM conversations UNION ALL SELECT 'document', CASE WHEN strlen(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4) END FROM documents),
    t AS (SELECT tool, count(*) AS calls, sum(o) AS original, sum(least(o, 200)) AS delivered FROM c GROUP BY tool UNION ALL SELECT 'total', count(*), sum(o), sum(least(o, 200)) FROM c)
    SELECT tool, calls, CAST(original AS BIGINT) AS original, CAST(delivered AS BIGINT) AS delivered, round(CASE WHEN original = 0 THEN 0 ELSE (1 - delivered / original) * 100 END, 6) AS savings_percent FROM t""")
def token_ledger(spark, sf):
    sized = lambda t, tool: t.select(tool.alias("tool"), S.tokens(F.col("text")).alias("original"))
    calls = sized(A.table(spark, sf, "conversations"), F.col("role")).unionByName(sized(A.table(spark, sf, "documents"), F.lit("document")))
    return session.ledger(calls.withColumn("delivered", F.least("original", F.lit(200)))).withColumn("savings_percent", F.round("savings_percent", 6))


_STATS = A.with_tables("touches") + f", stats AS (SELECT file, min(days) AS last_edit_days, count(*) FILTER (days <= 90) AS commits_90d FROM (SELECT file, greatest(date_diff('day', ts, TIMESTAMP '{A.NOW}'), 0) AS days FROM touches) WHERE days <= 365 GROUP BY file) "
_SIGNALS = """, parts AS (SELECT 'part/' || p_partkey AS file, p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 + p_partkey % 7 END AS distance FROM part),
    signals AS (SELECT id, file, 1.0::DOUBLE / (1 + distance) AS graph_distance, 1.0::DOUBLE / (1 + coalesce(last_edit_days, 365) / 30.0::DOUBLE) AS recency, least(1.0::DOUBLE, coalesce(commits_90d, 0) / 20.0::DOUBLE) AS edit_frequency FROM parts LEFT JOIN stats USING (file)) """


def _signals(spark, sf):
    p, key = A.table(spark, sf, "part"), F.col("p_partkey")
    parts = p.select(F.concat(F.lit("part/"), key).alias("file"), key.alias("id"), F.when(key % 10 == 0, 0).when(key % 3 == 0, 1).otherwise(3 + key % 7).alias("distance"), F.lit(0.0).alias("tested"))
    return select.signals(parts, select.touch_stats(A.touches(spark, sf), F.lit(A.NOW)))


@query(_STATS + "SELECT file, last_edit_days, commits_90d FROM stats")
def recency_frequency(spark, sf):
    return select.touch_stats(A.touches(spark, sf), F.lit(A.NOW))


@query(_STATS + _SIGNALS + """, s AS (SELECT id, graph_distance * 0.2222::DOUBLE + recency * 0.2778::DOUBLE + edit_frequency * 0.2222::DOUBLE AS score FROM signals)
    SELECT id, round(score, 9) AS score FROM s WHERE score >= 0.6::DOUBLE * (SELECT max(score) FROM s)""")
def scored_candidates(spark, sf):
    got = _signals(spark, sf).withColumn("score", select.score("fix_bug"))
    return select.cliff(got.select("id", "score")).select("id", F.round("score", 9).alias("score"))


@query(_STATS + _SIGNALS + """, c AS (SELECT s.id, p_brand AS brand, round(graph_distance * 0.3333::DOUBLE + recency * 0.2667::DOUBLE + edit_frequency * 0.2::DOUBLE, 6) AS score, CASE WHEN s.id % 4 = 0 THEN 'doc' ELSE 'dependency' END AS category,
        20 + s.id % 90 AS f, 5 + s.id % 11 AS g, 3 + s.id % 3 AS r FROM signals s JOIN part ON p_partkey = s.id),
    k AS (SELECT *, max(score) OVER (PARTITION BY brand) AS peak FROM c),
    o AS (SELECT *, CASE WHEN category = 'doc' THEN r WHEN score >= 0.15 THEN f ELSE g END AS w, row_number() OVER (PARTITION BY brand, category ORDER BY score DESC, id) AS n FROM k WHERE score >= peak * 0.6::DOUBLE),
    fold AS (SELECT brand, category, 0::BIGINT AS n, CASE category WHEN 'doc' THEN 100 ELSE 250 END::BIGINT AS budget, NULL::BIGINT AS id, 0::BIGINT AS cost, NULL::VARCHAR AS disclosure FROM (SELECT DISTINCT brand, category FROM o)
        UNION ALL SELECT o.brand, o.category, o.n, budget - CASE WHEN w <= budget THEN w WHEN g <= budget THEN g WHEN r <= budget THEN r ELSE 0 END, o.id, CASE WHEN w <= budget THEN w WHEN g <= budget THEN g WHEN r <= budget THEN r ELSE 0 END,
            CASE WHEN w <= budget THEN CASE WHEN category = 'doc' THEN 'reference' WHEN score >= 0.15 THEN 'full' ELSE 'signature' END WHEN g <= budget THEN 'signature' WHEN r <= budget THEN 'reference' END
        FROM fold JOIN o USING (brand, category) WHERE o.n = fold.n + 1)
    SELECT brand, category, id, disclosure, cost FROM fold WHERE disclosure IS NOT NULL""")
def budget_selection(spark, sf):
    key = F.col("id")
    got = _signals(spark, sf).withColumn("score", F.round(select.score(), 6)).join(A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), "id")
    got = got.withColumn("category", F.when(key % 4 == 0, "doc").otherwise("dependency"))
    wanted = F.when(F.col("category") == "doc", "reference").when(F.col("score") >= select.RELEVANT, "full").otherwise("signature")
    costs = {"cost_full": (20 + key % 90).cast("long"), "cost_signature": (5 + key % 11).cast("long"), "cost_reference": (3 + key % 3).cast("long")}
    got = got.select("brand", "category", "score", key.alias("pos"), key.cast("string").alias("id"), wanted.alias("wanted"), *[c.alias(n) for n, c in costs.items()])
    return select.select(got, 1000, "brand").select("brand", "category", F.col("id").cast("long").alias("id"), "disclosure", "cost")


@query(A.with_tables("lines") + """, size AS (SELECT file, max(line) AS n FROM lines GROUP BY file), hits AS (SELECT file, line FROM lines WHERE contains(lower(text), 'license')),
    raw AS (SELECT DISTINCT file, n, greatest(1, line - 2) AS s, least(n, line + 2) AS e FROM hits JOIN size USING (file)),
    f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS new FROM raw),
    i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f), m AS (SELECT file, n, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
    c AS (SELECT *, sum(e - s + 1) OVER (PARTITION BY file) AS covered FROM m)
    SELECT DISTINCT file, CAST(CASE WHEN n <= 80 OR covered >= n * 0.8 THEN 1 ELSE s END AS INTEGER) AS "start", CAST(CASE WHEN n <= 80 OR covered >= n * 0.8 THEN n ELSE e END AS INTEGER) AS "end" FROM c""")
def line_windows(spark, sf):
    lines = A.lines(spark, sf)
    hit = text.hits(lines, "license").select("file", F.col("line").alias("start"), F.col("line").alias("end"), F.lit(True).alias("full")).distinct()
    return select.windows(hit, lines.groupBy("file").agg(F.max("line").alias("lines"))).select("file", "start", "end")


@query(A.with_tables("reads") + """, l AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(content_hash) OVER w = content_hash, FALSE) AS same, lag(tokens) OVER w AS previous,
        coalesce(sum(tokens) OVER (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM reads WINDOW w AS (PARTITION BY session, file ORDER BY ts, seq)),
    c AS (SELECT *, CASE WHEN (sent - coalesce(previous, 0)) / 8000.0::DOUBLE < 0.3::DOUBLE THEN 'high' WHEN (sent - coalesce(previous, 0)) / 8000.0::DOUBLE < 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM l)
    SELECT seq, session, file, CAST(n AS INTEGER) AS count, confidence, CASE WHEN n = 0 OR NOT same THEN 'full-fresh' WHEN n >= 3 THEN CASE confidence WHEN 'high' THEN 'sha-pointer' ELSE 'escalated-full' END
        WHEN n = 2 THEN CASE confidence WHEN 'high' THEN 'sha-pointer' WHEN 'medium' THEN 'session-signature' ELSE 'full-fresh' END ELSE 'sha-pointer' END AS strategy FROM c""")
def read_strategy(spark, sf):
    return session.read_strategies(A.reads(spark, sf), 8000).select("seq", "session", "file", "count", "confidence", "strategy")


@query(A.with_tables("reads") + """SELECT session, file, CAST(rank AS INTEGER) AS rank FROM (SELECT session, file, row_number() OVER (PARTITION BY session ORDER BY max(ts) DESC, max(seq) DESC) AS rank FROM reads GROUP BY session, file) WHERE rank <= 3""")
def recent_files(spark, sf):
    return session.recent(A.reads(spark, sf), 3)


_DRIFT = A.with_tables("base", "head") + """, diff AS (SELECT coalesce(b.file, h.file) AS file, coalesce(b.name, h.name) AS name, b.body AS b0, h.body AS b1, b.signature AS s0, h.signature AS s1,
        CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' WHEN b.body <> h.body OR b.signature <> h.signature THEN 'changed' END AS change FROM base b FULL JOIN head h ON b.file = h.file AND b.name = h.name),
    g AS (SELECT file, b0 AS body, min(name) AS old, count(*) AS n FROM diff WHERE change = 'removed' GROUP BY ALL), a AS (SELECT file, b1 AS body, min(name) AS new, count(*) AS n FROM diff WHERE change = 'added' GROUP BY ALL),
    ren AS (SELECT g.file, old, new FROM g JOIN a ON g.file = a.file AND g.body = a.body AND g.n = 1 AND a.n = 1),
    drift AS (SELECT d.file, d.name, CASE WHEN r.old IS NOT NULL THEN 'renamed' ELSE change END AS change, change = 'changed' AND s0 <> s1 AS signature_changed, change = 'changed' AND b0 <> b1 AS body_changed,
        r.old IS NOT NULL OR change = 'removed' OR (change = 'changed' AND s0 <> s1) AS breaking, r.old AS renamed_from
        FROM diff d LEFT JOIN ren r ON d.file = r.file AND d.name = r.new LEFT JOIN ren w ON d.file = w.file AND d.name = w.old WHERE change IS NOT NULL AND w.old IS NULL) """


@query(_DRIFT + "SELECT file, name, change, coalesce(signature_changed, FALSE) AS signature_changed, coalesce(body_changed, FALSE) AS body_changed, coalesce(breaking, FALSE) AS breaking, renamed_from FROM drift")
def drift_report(spark, sf):
    return session.symbol_drift(*A.snapshots(spark, sf))


@query(A.with_tables("base", "head") + """, b AS (SELECT file || '/' || name AS file, sha256(body) AS sha FROM base), h AS (SELECT file || '/' || name AS file, sha256(body) AS sha FROM head)
    SELECT count(h.file) AS files_seen, count(*) FILTER (h.file IS NOT NULL AND b.sha IS DISTINCT FROM h.sha) AS files_updated, count(*) FILTER (h.file IS NOT NULL AND b.sha = h.sha) AS files_skipped, count(*) FILTER (h.file IS NULL) AS files_pruned FROM b FULL JOIN h USING (file)""")
def index_delta(spark, sf):
    one = lambda d: d.select(F.concat_ws("/", "file", "name").alias("file"), F.sha2("body", 256).alias("sha"))
    return session.index_delta(*map(one, A.snapshots(spark, sf)))


@query(A.with_tables("lines", "blocks") + """SELECT b.file, b.id AS key, sha256(string_agg(l.text, chr(10) ORDER BY l.line)) AS sha FROM blocks b JOIN lines l ON l.file = b.file AND l.line BETWEEN b."start" AND b."end" WHERE b.id NOT LIKE '%::all' GROUP BY ALL""")
def symbol_sha(spark, sf):
    lines = A.lines(spark, sf)
    spans = A.blocks(lines).where(~F.col("id").endswith("::all")).withColumnRenamed("id", "key")
    return session.symbol_shas(lines, spans)


_CALLS = A.with_tables("lines", "blocks", "changed") + """, sites AS (SELECT DISTINCT b.id AS symbol, l.file, l.line FROM lines l JOIN blocks b ON l.file = b.file AND l.line BETWEEN b."start" AND b."end" WHERE b.id NOT LIKE '%::all' AND contains(l.text, 'of')),
    req AS (SELECT id AS symbol, file, "start", "end" FROM blocks WHERE id NOT LIKE '%::all'),
    missed AS (SELECT symbol, file, CAST(line AS BIGINT) AS line, 'line' AS detail FROM sites s WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.file = s.file AND s.line BETWEEN c."start" AND c."end")
        UNION ALL SELECT symbol, file, "start", 'span' FROM req r WHERE symbol NOT IN (SELECT symbol FROM sites) AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.file = r.file AND r."start" <= c."end" AND r."end" >= c."start")) """


def _missed(spark, sf):
    lines = A.lines(spark, sf)
    spans = A.blocks(lines).where(~F.col("id").endswith("::all"))
    calls = lines.where(F.contains("text", F.lit("of"))).join(spans, "file").where("line BETWEEN start AND end").select(F.col("id").alias("symbol"), F.lit("of").alias("callee"), "line")
    required = spans.select(F.col("id").alias("symbol"), F.lit("of").alias("seed"), "file", "start", "end")
    return verify.missed(required, calls, A.changed(lines, A.table(spark, sf, "documents")))


@query(_CALLS + "SELECT * FROM missed")
def missed_sites(spark, sf):
    return verify.ordered_missed(_missed(spark, sf)).select("symbol", "file", F.col("line").cast("long").alias("line"), "detail")


@query(_CALLS + """SELECT (SELECT count(*) FROM changed) AS changes, (SELECT count(*) FROM missed) AS missed, 0::BIGINT AS unverified, 0::BIGINT AS arch_fail, 0::BIGINT AS arch_review,
    CASE WHEN (SELECT count(*) FROM changed) = 0 THEN 'clean' WHEN (SELECT count(*) FROM missed) > 0 THEN 'incomplete' ELSE 'complete' END AS verdict""")
def verify_verdict(spark, sf):
    lines = A.lines(spark, sf)
    none = spark.createDataFrame([], "level string")
    return verify.verdict(A.changed(lines, A.table(spark, sf, "documents")), _missed(spark, sf), none, none)


_TOUCHED = _CROSS + ", ch AS (SELECT file_path AS file, \"start\" - 5 AS s, \"start\" + 5 AS e FROM symbols WHERE id LIKE 'c:%' AND (CAST(substr(id, 3) AS BIGINT) % 3 = 0 OR file_path LIKE 'AFRICA/NATION_0/%')) "


@query(_TOUCHED + """SELECT src_comp, dst_comp, count(*) AS weight FROM crossed c WHERE src_comp <> dst_comp GROUP BY ALL HAVING bool_and(EXISTS (SELECT 1 FROM ch WHERE ch.file = c.src_file AND c.src_line BETWEEN s AND e))""")
def new_dependencies(spark, sf):
    return verify.new_dependencies(_crossed(spark, sf), _customer_changes(spark, sf))


def _customer_changes(spark, sf):
    own = (F.substring_index("id", ":", -1).cast("long") % 3 == 0) | F.startswith("file_path", F.lit("AFRICA/NATION_0/"))
    s = A.symbols(spark, sf).where(F.startswith("id", F.lit("c:")) & own)
    return s.select(F.col("file_path").alias("file"), (F.col("start") - 5).alias("start"), (F.col("start") + 5).alias("end"))


@query(_TOUCHED + f""", ie AS (SELECT src_comp, dst_comp, {_COUNTS}, bool_or(EXISTS (SELECT 1 FROM ch WHERE ch.file = c.src_file AND c.src_line BETWEEN s AND e)) AS any_hit FROM crossed c WHERE src_comp <> dst_comp GROUP BY ALL)
    SELECT src_comp, dst_comp, weight, CASE min_tier WHEN 'heuristic' THEN 'review' ELSE 'fail' END AS level FROM ie WHERE any_hit AND regexp_full_match(src_comp, 'AFRICA/[^/]*') AND regexp_full_match(dst_comp, 'AMERICA/[^/]*')""")
def introduced_violations(spark, sf):
    crossed = _crossed(spark, sf)
    bad = view.violations(spark, view.induced(crossed, 0), view.parse_rules(RULES[:1])).select("src_comp", "dst_comp", "min_tier")
    return verify.introduced_violations(crossed, _customer_changes(spark, sf), bad).select("src_comp", "dst_comp", "weight", "level")


_CUT = "CASE WHEN length(trim({c})) > {n} THEN left(trim({c}), {n}) || '…' ELSE trim({c}) END"
_TOK = "CASE WHEN strlen({c}) = 0 THEN 0 ELSE greatest(1, strlen({c}) // 4) END"


@query(A.with_tables("turns") + f""", k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns), l AS (SELECT *, kind = 'exploration' AND back > 3 AS look FROM k),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, look, sha256(content) ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id, look, sha256(content)) AS times FROM l),
    t AS (SELECT *, CASE WHEN back <= 3 THEN content WHEN look THEN '[' || kind || '] ' || {_CUT.format(c='content', n=120)} WHEN kind = 'implementation' THEN {_CUT.format(c='content', n=400)} ELSE {_CUT.format(c='content', n=200)} END AS short FROM s)
    SELECT conv_id, turn, CASE WHEN look AND nth = 1 AND times > 1 THEN '[dedup] previous exploration repeated' ELSE short END AS content, {_TOK.format(c='content')} AS original, {_TOK.format(c='short')} AS delivered FROM t""")
def compacted_turns(spark, sf):
    return session.compact(A.turns(spark, sf)).select("conv_id", "turn", "content", "original", "delivered")


def _votes(name: str) -> str:
    each = [r"CASE WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])" + w + r"($|[^\p{L}\p{N}_])') THEN 1 ELSE 0 END" for w in session.PHASES[name]]
    return " + ".join(each)


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), v AS (SELECT doc_id, " + ", ".join(f"{_votes(n)} AS {n}" for n in session.PHASES) + """ FROM d)
    SELECT doc_id, debug, review, implement, explore, CASE greatest(debug, review, implement, explore) WHEN 0 THEN 'unknown' WHEN debug THEN 'debug' WHEN review THEN 'review' WHEN implement THEN 'implement' ELSE 'explore' END AS phase FROM v""")
def phase_vote(spark, sf):
    votes, best = session.phase(F.coalesce("text", F.lit("")))
    return A.table(spark, sf, "documents").select("doc_id", *[v.alias(n) for n, v in votes.items()], best.alias("phase"))


@query("""WITH o AS (SELECT 'default' AS name, event_id AS seq, value > 50 AS cited FROM events WHERE event_type = 'click'),
    n AS (SELECT cited, row_number() OVER (ORDER BY seq) AS n FROM o),
    f AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT 0::BIGINT AS n, 0.0::DOUBLE AS g UNION ALL SELECT n.n, greatest(-0.4::DOUBLE, least(0.4::DOUBLE, g + CASE WHEN cited THEN 0.02::DOUBLE ELSE -0.01::DOUBLE END)) FROM f JOIN n ON n.n = f.n + 1) SELECT * FROM f))
    SELECT 'default' AS name, round(arg_max(g, n), 9) AS graph_distance FROM f""")
def learned_weights(spark, sf):
    e = A.table(spark, sf, "events").where("event_type = 'click'")
    hit = (F.coalesce(F.col("value"), F.lit(0.0)) > 50).cast("double")
    outcomes = e.select(F.lit("default").alias("name"), F.col("event_id").alias("seq"), hit.alias("cited"), (1 - hit).alias("uncited"), F.lit(False).alias("missing_tests"))
    return select.learn(outcomes).select("name", F.round("graph_distance", 9).alias("graph_distance"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 600000000 THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(*) AS events, min(t) AS first_us, max(t) AS last_us FROM s GROUP BY user_id, k""")
def debounced_batches(spark, sf):
    from impactgraph.streaming import sessions

    e = A.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = sessions.debounced(e, "user_id", "10 minutes")
    return got.select("user_id", "events", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


@query(A.with_tables("lines") + "SELECT file, sha256(string_agg(CASE WHEN contains(lower(text), 'license') THEN regexp_replace(text, 'license', 'licence', 'gi') ELSE text END, chr(10) ORDER BY line)) AS sha FROM lines GROUP BY file")
def rename_applied(spark, sf):
    files = A.files(spark, sf)
    edits = text.hits(A.split_lines(files), "license").select("file", "line", F.regexp_replace("text", "\r$", "").alias("before"), F.regexp_replace("text", "(?i)license", "licence").alias("after"))
    whole, _ = graph.apply_edits(files, edits)
    return whole.select("file", F.sha2("content", 256).alias("sha"))


@query(A.with_tables("lines", "blocks") + """, sh AS (SELECT b.file, b.id, b."start", b."end", sha256(string_agg(l.text, chr(10) ORDER BY l.line)) AS sha, bool_or(l.line % 13 = 5) AS moved FROM blocks b JOIN lines l ON l.file = b.file AND l.line BETWEEN b."start" AND b."end" WHERE b.id NOT LIKE '%::all' GROUP BY ALL),
    same AS (SELECT * FROM sh WHERE NOT moved),
    rows_ AS (SELECT l.file, l.line, CASE WHEN s.id IS NULL THEN l.text WHEN l.line = s."start" THEN '… [' || s.id || ' unchanged, sha ' || left(s.sha, 8) || '] …' END AS t, (s.id IS NOT NULL AND l.line = s."start")::INT AS p
        FROM lines l LEFT JOIN same s ON s.file = l.file AND l.line BETWEEN s."start" AND s."end" WHERE l.file IN (SELECT file FROM same))
    SELECT file, CAST(sum(p) AS BIGINT) AS pointers, sha256(string_agg(t, chr(10) ORDER BY line)) AS sha FROM rows_ WHERE t IS NOT NULL GROUP BY file""")
def semantic_delta(spark, sf):
    lines = A.lines(spark, sf)
    spans = A.blocks(lines).where(~F.col("id").endswith("::all")).withColumnRenamed("id", "key")
    before = session.symbol_shas(lines.withColumn("text", F.when(F.col("line") % 13 == 5, F.concat("text", F.lit("~"))).otherwise(F.col("text"))), spans)
    return session.semantic_delta(lines, spans, before).select("file", "pointers", F.sha2("content", 256).alias("sha"))
