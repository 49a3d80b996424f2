"""Queries on scalar rules, cuts, orders and the small operators of search, selection and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactgraph.functions import scalars as S
from impactgraph.operators import context, graph, lookup, select, session, text, verify, view
from impactgraph.plans.catalog import _DRIFT, _SIGNALS, _STATS, TERM, _part_symbols, _signals, query
from impactgraph.sources import adapters as A

#: Paths that tell the rules apart; parts are dealt over them.
PATHS = [
    "src/x_test.go", "pkg/mock/a.ts", "tests/conftest.py", "lib/spec/b.spec.js", "Docs/R.md", "a/__tests__/c.tsx", "w/FooTest.java", "q/src/test/d.cs", "plain.sql", "x/y/z.rs",
    "k/test_m.py", "s/stub/n.kt", "u/testdata/t.go", "v/e.test.mjs", "deep/er/and/deeper.hpp", "z/f_spec.rb", "Makefile", "y/g.tests.php",
]


def _paths(spark, sf):
    p = A.table(spark, sf, "part")
    at = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("p_partkey") % len(PATHS) + 1).cast("int"))
    return p.withColumn("path", at)


_PATHS = f"WITH p AS (SELECT *, list_extract([{', '.join(repr(x) for x in PATHS)}], CAST(p_partkey % {len(PATHS)} + 1 AS INTEGER)) AS path FROM part), b AS (SELECT *, lower(path) AS lp, regexp_extract(path, '[^/]*$') AS base FROM p), e AS (SELECT *, regexp_extract(lower(base), '[.][^.]*$') AS ext, regexp_replace(lower(base), '[.][^.]*$', '') AS stem FROM b) "
_CATEGORY_TEST = "(regexp_matches(lp, '_test[.]|[.]test[.]|[.]spec[.]|/__tests__/|/tests/|/test/') OR regexp_matches(lp, '(_test[.]py|test[.]java|tests[.]java|_test[.]rs|tests[.]rs|_test[.]c|_test[.]h|_test[.]cc|_test[.]cpp|test[.]cs|tests[.]cs|test[.]php|tests[.]php)$'))"


@query(_PATHS + f"""SELECT p_partkey AS id, regexp_matches(lp, '_test[.]go$|mock|fake|stub|/testdata/') AS test_double,
    regexp_matches(base, '_test[.]go$|^test_|[.]test[.]|[.]spec[.]') OR regexp_matches(path, '/test/|/tests/|/__tests__/|src/test/') AS verify_test,
    regexp_matches('/' || lp, '/(test|tests|__tests__|testdata|spec|specs)/') OR regexp_matches(stem, '(_test|[.]test|[.]spec|_spec)$|^test_') OR lower(base) = 'conftest.py' OR (ext IN ('.java', '.cs', '.kt') AND regexp_matches(stem, 'tests?$')) AS view_test,
    CASE WHEN {_CATEGORY_TEST} THEN 'test' WHEN lp LIKE '%.md' THEN 'doc' WHEN p_size % 2 = 0 THEN 'doc' ELSE 'dependency' END AS category,
    CASE ext WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.java' THEN 'java' WHEN '.rb' THEN 'ruby' WHEN '.rs' THEN 'rust' WHEN '.hpp' THEN 'cpp' WHEN '.cs' THEN 'csharp' END AS tag,
    CASE WHEN ext IN ('.go', '.ts', '.tsx', '.js', '.mjs', '.java', '.rs', '.hpp', '.cs', '.php', '.kt') THEN '//' WHEN ext IN ('.py', '.rb') THEN '#' WHEN ext = '.sql' THEN '--' ELSE '' END AS comment FROM e""")
def path_rules(spark, sf):
    path, tag = F.col("path"), S.language_tag(F.col("path"))
    known = ("go", "python", "typescript", "javascript", "java", "ruby", "rust", "cpp", "csharp")
    kind = S.category(path, F.lit("function"), F.lit("doc"), F.when(F.col("p_size") % 2 == 0, "").otherwise("f()"), F.lit(""))
    return _paths(spark, sf).select(F.col("p_partkey").alias("id"), S.is_test_double(path).alias("test_double"), S.is_verify_test(path).alias("verify_test"), S.is_view_test(path).alias("view_test"), kind.alias("category"), F.when(tag.isin(*known), tag).alias("tag"), S.comment_prefix(path).alias("comment"))


@query(_PATHS + """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || '.' || p_name END AS shown, p_type || ' ' || p_name || ' (' || path || ':' || p_size || ')' AS reference, regexp_extract(p_brand || '.' || p_name, '[^.]*$') AS leaf,
    left(sha256(p_name), 8) AS sha, CASE WHEN length(p_name) > 9 THEN left(p_name, 9) || '…' ELSE p_name END AS short, 4 * (p_size % 4) + p_size % 3 AS indent, least(1.0::DOUBLE, greatest(0.2::DOUBLE, p_size / 40.0::DOUBLE)) AS clamped, left(sha1('/srv/' || 'repo'), 16) AS repository,
    CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory FROM e""")
def name_rules(spark, sf):
    qualified = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat_ws(".", "p_brand", "p_name"))
    line = F.concat(F.repeat(F.lit("\t"), (F.col("p_size") % 4).cast("int")), F.repeat(F.lit(" "), (F.col("p_size") % 3).cast("int")), F.lit("x\t y"))
    return _paths(spark, sf).select(
        F.col("p_partkey").alias("id"), S.display_name(qualified, F.col("p_name")).alias("shown"), S.reference(F.col("p_type"), F.col("p_name"), F.col("path"), F.col("p_size")).alias("reference"), S.leaf(F.concat_ws(".", "p_brand", "p_name")).alias("leaf"),
        S.short_sha(F.sha2("p_name", 256)).alias("sha"), S.summarize(F.col("p_name"), 9).alias("short"), S.indent_width(line).cast("long").alias("indent"), S.clamp(F.col("p_size") / 40.0, 0.2, 1.0).alias("clamped"), F.lit(S.repository_key("/srv/repo")).alias("repository"), S.directory(F.col("path")).alias("directory"),
    )


@query("""SELECT doc_id, sha256(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: CASE WHEN strlen(s) > 1200 THEN left(s, 1200) || '… [line truncated: ' || strlen(s) || ' bytes]' ELSE s END), chr(10))) AS clamped,
    CASE WHEN length(text) > 250 THEN left(text, 250) || '…' ELSE text END AS shown, len(string_split(text, chr(10))) >= 6 AND len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(trim(s), '^##|^[|] ?---|^- ..'))) >= 3 AS markdown FROM documents WHERE text IS NOT NULL""")
def text_cuts(spark, sf):
    docs = A.table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(S.clamp_lines(F.col("text")), 256).alias("clamped"), S.hit_line(F.col("text")).alias("shown"), S.is_markdown_const(F.col("text")).alias("markdown"))


_MODELS = [("gemini-1.5-pro", 1_000_000), ("Gemini-2.0", 1_000_000), ("gemini-pro", 128_000), ("gpt-4o", 128_000), ("gpt-3.5", 16_000), (" o3-mini ", 128_000), ("unheard-of", 128_000), ("", 200_000)]


@query(f"SELECT n_nationkey AS id, list_extract({[n for _, n in _MODELS]}, CAST(n_nationkey % {len(_MODELS)} + 1 AS INTEGER))::BIGINT AS tokens FROM nation")
def context_windows(spark, sf):
    model = F.element_at(F.array(*[F.lit(m) for m, _ in _MODELS]), (F.col("n_nationkey") % len(_MODELS) + 1).cast("int"))
    return A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), S.context_window(model).cast("long").alias("tokens"))


_LEVELS = _STATS + _SIGNALS + """, c AS (SELECT s.id, round(graph_distance * 0.3333::DOUBLE + recency * 0.2667::DOUBLE + edit_frequency * 0.2::DOUBLE, 6) AS score, CASE WHEN s.id % 9 = 0 THEN 'doc' ELSE 'dependency' END AS category, s.id % 4 = 0 AS seen,
        CASE s.id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, s.id % 20 BETWEEN 1 AND 8 AND p_size % 2 = 0 AS trivial, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size FROM signals s JOIN part ON p_partkey = s.id),
    w AS (SELECT *, CASE WHEN category = 'doc' THEN 'reference' WHEN seen AND confidence = 'high' THEN 'reference' WHEN seen AND confidence = 'medium' THEN 'signature' WHEN trivial THEN 'signature' WHEN score >= 0.15::DOUBLE THEN 'full' ELSE 'signature' END AS wanted FROM c),
    r AS (SELECT *, CASE wanted WHEN 'full' THEN repeat(name || ' ', CAST(size AS INTEGER)) WHEN 'signature' THEN brand || chr(10) || type ELSE 'function ' || name || ' (' || brand || ':' || size || ')' END AS t FROM w) """


@query(_LEVELS + "SELECT id, wanted, greatest(1, strlen(t) // 4) AS cost FROM r")
def disclosure_levels(spark, sf):
    key, size = F.col("id"), F.col("p_size")
    got = _signals(spark, sf).withColumn("score", F.round(select.score(), 6)).join(A.table(spark, sf, "part").withColumnRenamed("p_partkey", "id"), "id")
    got = got.withColumns({
        "category": F.when(key % 9 == 0, "doc").otherwise("dependency"), "seen": key % 4 == 0, "confidence": F.when(key % 3 == 0, "high").when(key % 3 == 1, "medium").otherwise("low"),
        "trivial": S.is_trivial(F.lit("function"), F.lit(10), F.lit(10) + key % 20, size % 2), "kind": F.lit("function"), "language": F.lit("go"), "qualified_name": F.lit(""), "name": F.col("p_name"), "file_path": F.col("p_brand"), "start": size,
        "docstring": F.col("p_brand"), "signature": F.col("p_type"), "raw_text": F.repeat(F.concat("p_name", F.lit(" ")), size.cast("int")),
    })
    return got.withColumn("wanted", select.disclosure()).select("id", "wanted", S.tokens(select.rendered(F.col("wanted"))).alias("cost"))


@query("""WITH c AS (SELECT conv_id, role, 3 * turn + i AS seq, repeat(coalesce(text, ''), CASE WHEN turn % 3 = 0 THEN 40 ELSE 1 END) AS p, CASE WHEN (turn + i) % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM conversations, range(3) t(i)),
    l AS (SELECT *, row_number() OVER w AS seen, coalesce(lag(p) OVER w = p, FALSE) AS same FROM c WINDOW w AS (PARTITION BY conv_id, role ORDER BY seq))
    SELECT conv_id, role, seq, same AND strlen(p) // 4 >= 600 AND (seen = 2 OR confidence = 'high') AS pointer FROM l""")
def graph_pointers(spark, sf):
    """Every turn's text delivered three times over, long and short."""
    c = A.table(spark, sf, "conversations").withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    payload = F.expr("repeat(coalesce(text, ''), CASE WHEN turn % 3 = 0 THEN 40 ELSE 1 END)")
    results = c.select(F.col("conv_id").alias("session"), F.col("role").alias("key"), (3 * F.col("turn") + F.col("i")).alias("seq"), payload.alias("payload"), F.when((F.col("turn") + F.col("i")) % 2 == 0, "high").otherwise("low").alias("confidence"))
    return session.graph_deliveries(results).select(F.col("session").alias("conv_id"), F.col("key").alias("role"), "seq", "pointer")


_DELIVERED = """WITH d AS (SELECT 'f' || p_partkey AS file, p_size AS h, p_partkey AS pos FROM part), n AS (SELECT 'f' || p_partkey AS file, p_size + (p_partkey % 7 = 0)::INT AS h FROM part WHERE p_partkey % 5 <> 0),
    s AS (SELECT d.file, d.pos, CASE WHEN n.file IS NULL THEN 'deleted' WHEN n.h <> d.h THEN 'changed' END AS status FROM d LEFT JOIN n USING (file)) """


def _delivered(spark, sf):
    p, key = A.table(spark, sf, "part"), F.col("p_partkey")
    file = F.concat(F.lit("f"), key).alias("file")
    now = p.where(key % 5 != 0).select(file, (F.col("p_size") + (key % 7 == 0).cast("int")).alias("content_hash"))
    return p.select(file, F.col("p_size").alias("content_hash"), key.alias("pos")), now


@query(_DELIVERED + "SELECT file, status, CASE WHEN pos % 3 = 0 THEN 'merge' ELSE 'edit' END AS origin FROM s WHERE status IS NOT NULL AND pos < 500")
def file_drift(spark, sf):
    old, now = _delivered(spark, sf)
    return session.file_drift(old, now, old.where("pos % 3 = 0").select("file"))


@query(_DELIVERED + "SELECT count(*) AS stale, array_to_string(list_slice(list_sort(list(file)), 1, 5), ' ') AS first FROM s WHERE status IS NOT NULL AND pos < 50")
def stale_files(spark, sf):
    return session.stale_warning(*_delivered(spark, sf)).select("stale", F.array_join("first", " ").alias("first"))


@query(A.with_tables("base", "head") + "SELECT coalesce(b.file, h.file) AS file, coalesce(b.name, h.name) AS key, CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM base b FULL JOIN head h ON b.file = h.file AND b.name = h.name WHERE b.body IS DISTINCT FROM h.body")
def sha_drift(spark, sf):
    return session.sha_drift(*[d.select("file", F.col("name").alias("key"), F.sha2("body", 256).alias("sha")) for d in A.snapshots(spark, sf)])


@query(_DRIFT + "SELECT file, name, change FROM drift ORDER BY change, name, file LIMIT 40")
def first_drift(spark, sf):
    return session.drift_order(session.symbol_drift(*A.snapshots(spark, sf))).select("file", "name", "change").limit(40)


@query(_DRIFT + """, k AS (SELECT *, CASE CAST(regexp_extract(name, '#([0-9]+)', 1) AS BIGINT) % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'document' END AS kind FROM drift),
    s AS (SELECT name, file, CASE WHEN change = 'changed' THEN CASE WHEN signature_changed THEN 'signature' END ELSE change END AS because, CASE kind WHEN 'function' THEN 'seed' ELSE 'unverified' END AS state FROM k WHERE kind <> 'document' AND change <> 'added')
    SELECT * FROM s WHERE because IS NOT NULL""")
def change_seeds(spark, sf):
    n = F.regexp_extract("name", "#([0-9]+)", 1).cast("long") % 3
    drift = session.symbol_drift(*A.snapshots(spark, sf)).withColumn("kind", F.when(n == 0, "function").when(n == 1, "class").otherwise("document"))
    return verify.seeds(drift, drift)


@query("""WITH p AS (SELECT p_brand AS file, min_by(p_partkey, p_partkey) AS k, p_name AS name FROM part GROUP BY p_brand, p_name) SELECT file, name, 'int a, ' || (k % 5) AS p0, CASE WHEN k % 3 = 0 THEN 'int a, ' || (k % 5 + 1) ELSE 'int b' END AS p1 FROM p WHERE k % 3 < 2""")
def changed_parameters(spark, sf):
    p = A.table(spark, sf, "part").groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    side = lambda inner: p.select("file", F.lit(1).alias("line"), "name", F.concat(F.lit("  def "), "name", F.lit(" ("), inner, F.lit(") {")).alias("text"))
    before = F.concat(F.lit("int a,  "), F.col("k") % 5)
    after = F.when(F.col("k") % 3 == 0, F.concat(F.lit("int a, "), F.col("k") % 5 + 1)).when(F.col("k") % 3 == 1, F.lit("int b")).otherwise(before)
    return verify.member_changes(side(before), side(after))


@query("""SELECT 'p' || p_partkey AS file, greatest(1, p_size)::BIGINT AS "start", (greatest(1, p_size) + CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN p_partkey % 9 ELSE 0 END)::BIGINT AS "end" FROM part""")
def diff_ranges(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    count = F.when(key % 3 == 0, ",0").when(key % 3 == 1, F.concat(F.lit(","), key % 9 + 1)).otherwise("")
    head = A.table(spark, sf, "part").select(F.concat(F.lit("p"), key).alias("file"), F.concat(F.lit("@@ -3,2 +"), size, count, F.lit(" @@ x")).alias("text"))
    return verify.ranges(head).select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(A.with_tables("symbols") + "SELECT comp, count(DISTINCT file_path) AS files, count(*) AS symbols FROM symbols WHERE NOT test GROUP BY comp ORDER BY comp LIMIT 9")
def first_components(spark, sf):
    return view.component_order(view.components(A.symbols(spark, sf), A.edges(spark, sf))).select("comp", "files", "symbols").limit(9)


@query(A.with_tables("symbols") + "SELECT count(DISTINCT file_path) AS test_files FROM symbols WHERE test")
def excluded_tests(spark, sf):
    return view.excluded_tests(A.symbols(spark, sf))


@query("""WITH p AS (SELECT p_brand AS name, min(p_retailprice) / 10000 AS a, round(max(p_size) / 100.0::DOUBLE, 4) AS b FROM part GROUP BY p_brand), l AS (SELECT name, 0.3::DOUBLE AS d FROM p WHERE b > 0.45)
    SELECT name, round(CASE WHEN d IS NULL THEN a ELSE greatest(0.05::DOUBLE, least(1.0::DOUBLE, a + d)) END, 9) AS graph_distance, round(CASE WHEN d IS NULL THEN b ELSE greatest(0.05::DOUBLE, least(1.0::DOUBLE, b - d)) END, 9) AS recency FROM p LEFT JOIN l USING (name)""")
def weights_applied(spark, sf):
    p = A.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg((F.min("p_retailprice") / 10000).alias("graph_distance"), F.round(F.max("p_size") / 100.0, 4).alias("recency")).withColumns({"test_relevance": F.lit(0.2), "edit_frequency": F.lit(0.2)})
    learned = p.where("recency > 0.45").select("name", F.lit(0.3).alias("graph_distance"), F.lit(-0.3).alias("recency"), F.lit(0.0).alias("test_relevance"), F.lit(0.0).alias("edit_frequency"))
    return select.apply_learned(p, learned).select("name", F.round("graph_distance", 9).alias("graph_distance"), F.round("recency", 9).alias("recency"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 8 >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cited FROM events WHERE event_id % 8 IN (0, 1, 4, 5)")
def feedback_outcomes(spark, sf):
    rated = A.table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 8).alias("rating"))
    return select.feedback_outcomes(rated).select("seq", "cited")


_PARTS = "WITH p AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, CASE WHEN p_type = 'ECONOMY' THEN 'mock/' ELSE 'pkg/' END || p_brand || '.go' AS file_path, p_type AS signature FROM part) "


@query(_PARTS + """, t AS (SELECT * FROM (VALUES (0, 'red'), (1, 'econ'), (2, 'brand#1')) t(pos, term)),
    m AS (SELECT pos, term, id, name, CASE WHEN contains(lower(name), term) OR contains(lower(qualified_name), term) THEN CASE WHEN file_path LIKE 'mock%' THEN 1 ELSE 0 END WHEN contains(lower(signature), term) THEN 2 END AS class FROM p, t),
    r AS (SELECT *, row_number() OVER (PARTITION BY term, class = 2 ORDER BY class, name, id) AS rank FROM m WHERE class IS NOT NULL)
    SELECT id, min(pos * 1000 + class * 100 + rank)::BIGINT AS pos FROM r WHERE rank <= CASE WHEN class = 2 THEN 3 ELSE 5 END GROUP BY id""")
def term_seeds(spark, sf):
    s = _part_symbols(spark, sf).join(A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("signature")), "id")
    return lookup.term_seeds(s, text.term_list(spark, ["red", "econ", "brand#1"])).select("id", F.col("pos").cast("long").alias("pos"))


@query(_PARTS + """SELECT id, CASE WHEN lower(name) = 'ring' OR lower(qualified_name) = 'ring' THEN 0 WHEN lower(name) LIKE 'ring%' OR lower(qualified_name) LIKE 'ring%' THEN 1 ELSE 2 END AS rank FROM p WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring') ORDER BY rank, name, file_path, id LIMIT 5""")
def did_you_mean(spark, sf):
    return lookup.did_you_mean(_part_symbols(spark, sf), "ring").select("id", "rank")


_HITS = A.with_tables("lines") + f", hits AS (SELECT * FROM lines WHERE contains(lower(text), '{TERM}')) "


@query(_HITS + "SELECT file, CAST(line AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS rank FROM hits) WHERE rank <= 10000 ORDER BY file, line LIMIT 100000")
def exhaustive_hits(spark, sf):
    return text.exhaustive(text.hits(A.lines(spark, sf), TERM)).select("file", F.col("line").cast("long").alias("line"))


@query(_HITS + """, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS rank, count(*) OVER (PARTITION BY file) AS n FROM hits), f AS (SELECT DISTINCT file FROM hits ORDER BY file LIMIT 10)
    SELECT file, CAST(line AS BIGINT) AS line, CASE WHEN length(regexp_replace(text, chr(13) || '$', '')) > 250 THEN left(text, 250) || '…' ELSE regexp_replace(text, chr(13) || '$', '') END AS text, greatest(n - 5, 0) AS more FROM r WHERE rank <= 5 AND file IN (SELECT file FROM f)""")
def shown_hits(spark, sf):
    got = text.shown_hits(text.hits(A.lines(spark, sf), TERM))
    return got.select("file", F.col("line").cast("long").alias("line"), "text", "more")


@query(A.with_tables("lines") + r"""SELECT file, CAST(line AS BIGINT) AS line FROM lines WHERE contains(lower(text), 'license') AND (file LIKE 'src1/%' OR file LIKE 'src2/en/%') AND regexp_full_match(regexp_extract(file, '[^/]*$'), '[^/]*[13][^/]')""")
def scoped_hits(spark, sf):
    return text.hits(A.lines(spark, sf), "license", scope=["src1", "src2/en", "../x"], glob="*[13]?").select("file", F.col("line").cast("long").alias("line"))


@query(_HITS + "SELECT file, CAST(line AS BIGINT) AS line, CASE WHEN file LIKE '%/en/%' THEN '' ELSE text END AS text FROM hits WHERE contains(lower(text), 'license')")
def cached_hits(spark, sf):
    files = A.files(spark, sf).select("file", F.sha2("content", 256).alias("content_hash"))
    found = text.hits(A.lines(spark, sf), TERM).where(F.contains(F.lower("text"), F.lit("license")))
    got = text.cached_lines(found, files, files.where(F.contains("file", F.lit("/en/"))))
    return got.select("file", F.col("line").cast("long").alias("line"), F.coalesce("text", F.lit("")).alias("text"))


@query(A.with_tables("lines") + r""", h AS (SELECT count(*) AS hits FROM lines WHERE contains(lower(text), 'the')), r AS (SELECT count(*) AS refs FROM (SELECT unnest(string_split_regex(regexp_replace(text, '"(?:[^"\\]|\\.)*"', '""', 'g'), '[^\p{L}\p{N}_]+')) AS w FROM lines) WHERE w = 'the')
    SELECT hits, refs, CASE WHEN hits < 10 THEN '' WHEN refs > 0 AND refs * 2 <= hits THEN 'noise' ELSE '' END AS note FROM h, r""")
def noise_note(spark, sf):
    lines = A.lines(spark, sf)
    none = spark.createDataFrame([], "file string, line int, name string")
    return text.noise_note(text.hits(lines, TERM), text.references(lines, TERM, none), 1)


@query(A.with_tables("lines") + ", one AS (SELECT min(file) AS file FROM lines WHERE line = 9) SELECT CAST(line AS BIGINT) AS line, text, (SELECT count(*) FROM lines WHERE file = (SELECT file FROM one)) AS total_lines FROM lines WHERE file = (SELECT file FROM one) AND line BETWEEN 4 AND 6")
def read_window(spark, sf):
    lines = A.lines(spark, sf)
    file = lines.where("line = 9").agg(F.min("file")).first()[0]
    return text.read_range(lines, file, 4, 3).select(F.col("line").cast("long").alias("line"), "text", "total_lines")


@query(_STATS + _SIGNALS + """, f AS (SELECT p_brand AS file, max(round(recency, 6)) AS best, min(s.id) AS pos FROM signals s JOIN part ON p_partkey = s.id GROUP BY p_brand)
    SELECT file, row_number() OVER (ORDER BY best DESC, pos) AS rank FROM f""")
def file_ranking(spark, sf):
    got = _signals(spark, sf).join(A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), "id")
    ranked = select.file_order(got.select(F.col("brand").alias("file"), F.round("recency", 6).alias("score"), F.col("id").alias("pos")))
    return ranked.select("file", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT p_partkey AS rank, p_size * 3 AS cost FROM part), b AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT rank, CASE WHEN before + cost <= 2000 THEN 'whole' WHEN before = 0 THEN 'cut' ELSE 'listed' END AS state FROM b""")
def delivered_sections(spark, sf):
    return select.deliver(A.table(spark, sf, "part").select(F.col("p_partkey").alias("rank"), (F.col("p_size") * 3).alias("cost")), 1000).select("rank", "state")


@query("""SELECT greatest(CAST(sum(strlen(coalesce(text, '')) // 4) AS BIGINT), 100) AS baseline_tokens FROM documents""")
def baseline_tokens(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", A.document_file().alias("file"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    return select.baseline_tokens(docs, docs, F.lit(100).cast("long"))


@query(A.with_tables("symbols", "edges") + """, a AS (SELECT id, row_number() OVER (ORDER BY CAST(substr(id, 3) AS BIGINT)) AS pos FROM symbols WHERE id LIKE 's:%' ORDER BY pos LIMIT 5)
    SELECT a.id, count(src) AS callers, array_to_string(list_slice(list_sort(list_distinct(list(file_path))), 1, 3), ' ') AS files, greatest(count(DISTINCT file_path) - 3, 0) AS more FROM a LEFT JOIN (SELECT dst, src, file_path FROM edges JOIN symbols ON src = id WHERE type = 'calls') c ON c.dst = a.id GROUP BY a.id""")
def anchor_summary(spark, sf):
    s, e = A.symbols(spark, sf), A.edges(spark, sf).where("type = 'calls'")
    anchors = s.where(F.startswith("id", F.lit("s:"))).select("id", F.substring_index("id", ":", -1).cast("long").alias("pos"))
    calls = e.join(s.select(F.col("id").alias("src"), F.col("file_path").alias("src_file")), "src")
    return select.anchor_summary(anchors, calls).select("id", "callers", F.array_join("files", " ").alias("files"), F.col("more").cast("long").alias("more"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 4 = 0 THEN 1 ELSE 3 + p_partkey // 10 END AS distance FROM part WHERE p_size % 4 <> 0 AND p_size % 4 <> 1""")
def included_distances(spark, sf):
    key, kind = F.col("p_partkey"), F.col("p_size") % 4
    rows = A.table(spark, sf, "part").select(key.alias("id"), key.alias("pos"), (key % 10 == 0).alias("seed"), (key % 4 == 0).alias("neighbor"), F.when(kind == 0, "test").when(kind == 1, "doc").when(kind == 2, "target").otherwise("dependency").alias("category"))
    return select.graph_distance(select.included(rows)).select("id", F.col("distance").cast("long").alias("distance"))


@query("""WITH s AS (SELECT 'd' || p_brand AS file, min(p_size) AS s, 200::BIGINT AS n FROM part GROUP BY p_brand) SELECT file, greatest(s - 2, 1)::BIGINT AS "start", least(s + 7 + 2, n)::BIGINT AS "end" FROM s""")
def signature_windows(spark, sf):
    spans = A.table(spark, sf, "part").groupBy(F.concat(F.lit("d"), "p_brand").alias("file")).agg(F.min("p_size").cast("int").alias("start")).select("file", "start", (F.col("start") + 60).alias("end"), F.lit(False).alias("full"))
    return select.windows(spans, spans.select("file", F.lit(200).alias("lines"))).select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS confirmed FROM part) SELECT id, confirmed FROM p ORDER BY NOT confirmed, id LIMIT 30""")
def confirmed_seeds(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"))
    return text.confirmed_first(p, p.where("id % 3 = 0")).select("id", "confirmed").limit(30)


@query("""SELECT p_partkey AS id FROM part WHERE NOT (p_brand = 'Brand#1' OR (p_brand = 'Brand#2' AND contains(p_name, 'red')))""")
def without_generated(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("./"), "p_brand").alias("file_path"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("raw_text"), F.col("p_name").alias("docstring"))
    return context.without_generated(p, ["Brand#1"], ["Brand#2"], "red").select("id")


@query("""WITH r AS (SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'semantic-delta' WHEN 1 THEN 'sha-pointer' ELSE 'full-fresh' END AS strategy, event_id % 90 * 1000 AS original, event_id % 70 * 1000 AS delivered FROM events),
    c AS (SELECT *, least(delivered, 50000) AS cut FROM r), b AS (SELECT *, original > 0 AND cut > original AND strategy <> 'full-fresh' AS back FROM c)
    SELECT seq, CASE WHEN back THEN 'full-fresh' ELSE strategy END AS strategy, CASE WHEN back THEN original ELSE cut END AS delivered, greatest(original, coalesce(nullif(delivered, 0), 0)) AS since FROM b""")
def capped_reads(spark, sf):
    key = F.col("event_id")
    name = F.when(key % 3 == 0, "semantic-delta").when(key % 3 == 1, "sha-pointer").otherwise("full-fresh")
    strategy, delivered = session.capped(name, key % 90 * 1000, key % 70 * 1000)
    since = session.distance(key % 90 * 1000, F.nullif(key % 70 * 1000, F.lit(0)))
    return A.table(spark, sf, "events").select(key.alias("seq"), strategy.alias("strategy"), delivered.alias("delivered"), since.alias("since"))


@query(A.with_tables("symbols", "edges") + """, pairs AS (SELECT f.comp AS a, t.comp AS b, count(*) AS weight FROM edges JOIN symbols f ON src = f.id JOIN symbols t ON dst = t.id WHERE NOT f.test AND NOT t.test AND f.comp <> t.comp GROUP BY ALL) SELECT a AS src_comp, b AS dst_comp, weight FROM pairs ORDER BY weight DESC, a, b LIMIT 15""")
def heaviest_edges(spark, sf):
    return view.ordered(view.induced(view.crossings(A.symbols(spark, sf), A.edges(spark, sf)), 0)).select("src_comp", "dst_comp", "weight").limit(15)
