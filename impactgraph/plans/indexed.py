"""Queries on the stored trigram index of documents and of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.operators import search
from impactgraph.plans.catalog import query
from impactgraph.sources import adapters as A
from impactgraph.sources import scratch

#: What is looked for: a rare and a common literal, one of mixed case, a short one, an unknown one, and expressions with a
#: required part, alternatives, an optional part, no required part, and one that doesn't compile.
TERMS = [("license", False), ("the", False), ("Rights Reserved", False), ("of", False), ("zzqqzz", False), ("licen[cs]e|warrant(y|ies)", True), ("(all )?rights\\s+reser", True), ("[0-9]{4}", True), ("under+ the", True), ("a(b", True)]
_SQL = ", ".join("({}, '{}', '{}')".format(i, t.replace("'", "''"), "(?i)" + (t if r and t != "a(b" else "a\\(b")) for i, (t, r) in enumerate(TERMS))
_PLAIN = ", ".join(str(i) for i, (t, r) in enumerate(TERMS) if not r)


def index(spark: SparkSession, files: DataFrame, name: str) -> search.Index:
    return search.Index.build(files, scratch.folder(spark, name))


@query(A.with_tables("lines") + rf""", t AS (SELECT * FROM (VALUES {_SQL}) t(pos, term, pattern))
    SELECT pos, file, line FROM t JOIN lines ON CASE WHEN pos IN ({_PLAIN}) THEN contains(lower(text), lower(term)) ELSE regexp_matches(text, pattern) END""")
def indexed_hits(spark, sf):
    """All lines with each of the terms, from one index."""
    own = index(spark, A.files(spark, sf), "indexed-hits")
    found = [own.hits(t, r).select(F.lit(i).alias("pos"), "file", "line") for i, (t, r) in enumerate(TERMS)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumn("line", F.col("line").cast("long"))


@query(A.with_tables("symbols", "lines") + r""", s AS (SELECT *, CASE WHEN lower(name) = 'customer#000000012' THEN 0 WHEN starts_with(lower(name), 'customer#000000012') THEN 1 ELSE 2 END AS rank, contains(lower(file_path), 'mock') OR contains(lower(file_path), 'fake') OR contains(lower(file_path), 'stub') OR contains(lower(file_path), '/testdata/') AS test_double FROM symbols WHERE contains(lower(name), 'customer#000000012')),
    h AS (SELECT * FROM lines WHERE contains(lower(text), 'license')),
    c AS (SELECT file, line, text FROM h QUALIFY row_number() OVER (PARTITION BY file ORDER BY line) <= 20)
    SELECT 'symbols' AS scope, 'symbol' AS section, file_path AS file, "start"::BIGINT AS line, id, NULL::BIGINT AS total, NULL::BIGINT AS files FROM (SELECT * FROM s ORDER BY rank, name, file_path, id LIMIT 25)
    UNION ALL SELECT 'both', 'text', file, line, NULL, NULL, NULL FROM (SELECT * FROM c ORDER BY file, line LIMIT 50)
    UNION ALL SELECT 'both', 'total', NULL, NULL, NULL, count(*), count(DISTINCT file) FROM h
    UNION ALL SELECT 'text', 'file', file, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT file FROM (SELECT * FROM c ORDER BY file, line LIMIT 30))
    UNION ALL SELECT 'text', 'total', NULL, NULL, NULL, count(*), count(DISTINCT file) FROM h""")
def one_term_search(spark, sf):
    """A name among symbols, and a word in text: with symbols, and the files of the first hits."""
    own = A.symbols(spark, sf)
    texts, names = index(spark, A.files(spark, sf), "search-text"), index(spark, search.symbol_files(own), "search-symbols")
    columns = ["section", "file", "line", "id", "total", "files"]
    asked = [("symbols", "Customer#000000012", {}), ("both", "license", {}), ("text", "license", {"limit": 30, "files_only": True})]
    parts = [search.search_one(texts, own, names, term, scope, **more).select(F.lit(scope).alias("scope"), *columns) for scope, term, more in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
