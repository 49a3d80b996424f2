"""Queries on sessions whose tracker forgets, and on delivered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.operators import delivery, reuse, text
from impactgraph.plans.catalog import query
from impactgraph.sources import adapters as A


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """Events as reads of their type's files: eight a type, by the hour."""
    e = A.reads(spark, sf)
    return e.withColumn("file", F.concat_ws("/", "file", (F.hour("ts") % 8).cast("string")))


_READS = A.with_tables("reads").rstrip() + """, r AS (SELECT session, file || '/' || hour(ts) % 8 AS file, content_hash, ts, seq, tokens, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS pos FROM reads),
    p AS (SELECT *, lag(pos) OVER (PARTITION BY session, file ORDER BY pos) AS before FROM r),
    d AS (SELECT a.session, a.pos, count(DISTINCT b.file) AS distance FROM p a LEFT JOIN p b ON b.session = a.session AND b.pos > a.before AND b.pos < a.pos WHERE a.before IS NOT NULL GROUP BY ALL),
    l AS (SELECT p.*, distance, sum((distance IS NULL OR distance >= 3)::INT) OVER (PARTITION BY p.session, file ORDER BY p.pos) AS life, coalesce(sum(tokens) OVER (PARTITION BY p.session ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM p LEFT JOIN d ON d.session = p.session AND d.pos = p.pos),
    g AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(content_hash) OVER w = content_hash, FALSE) AS same, lag(tokens) OVER w AS previous FROM l WINDOW w AS (PARTITION BY session, file, life ORDER BY pos)),
    c AS (SELECT *, CASE WHEN (sent - coalesce(previous, 0)) / 8000.0::DOUBLE < 0.3::DOUBLE THEN 'high' WHEN (sent - coalesce(previous, 0)) / 8000.0::DOUBLE < 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM g) """


@query(_READS + """SELECT seq, session, file, distance, CAST(n AS INTEGER) AS count, confidence, CASE WHEN n = 0 OR NOT same THEN 'full-fresh' WHEN n >= 3 THEN CASE confidence WHEN 'high' THEN 'sha-pointer' ELSE 'escalated-full' END
        WHEN n = 2 THEN CASE confidence WHEN 'high' THEN 'sha-pointer' WHEN 'medium' THEN 'session-signature' ELSE 'full-fresh' END ELSE 'sha-pointer' END AS strategy FROM c""")
def evicting_reads(spark, sf):
    """Every read's strategy when a session remembers three files."""
    return reuse.strategies(reads(spark, sf), 8000, 3).select("seq", "session", "file", "distance", "count", "confidence", "strategy")


_PICKED = A.with_tables("lines") + """, docs AS (SELECT concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id AS VARCHAR)) AS file, coalesce(lang, '') AS query, coalesce(text, '') AS content FROM documents),
    hit AS (SELECT d.query, l.file, line, line + strlen(text) % 30 AS e, strlen(text) % 2 = 0 AS full_, (strlen(text) % 97)::DOUBLE AS score FROM lines l JOIN docs d USING (file) WHERE contains(lower(text), 'the')),
    ord AS (SELECT query, file, row_number() OVER (PARTITION BY query ORDER BY max(score) DESC, min(line), file) AS rank FROM hit GROUP BY query, file),
    top AS (SELECT query, file, rank, content, len(string_split(content, chr(10))) - (content LIKE '%' || chr(10))::INT AS n FROM ord JOIN docs USING (query, file) WHERE rank <= 5),
    raw AS (SELECT query, file, n, greatest(1, line - 2) AS s, least(n, CASE WHEN NOT full_ AND e - line + 1 > 8 THEN line + 7 ELSE e END + 2) AS e FROM hit JOIN top USING (query, file)),
    fresh AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY query, file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5 THEN 0 ELSE 1 END AS new FROM raw),
    isl AS (SELECT *, sum(new) OVER (PARTITION BY query, file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM fresh), m AS (SELECT query, file, n, island, min(s) AS s, max(e) AS e FROM isl GROUP BY ALL),
    c AS (SELECT *, n <= 80 OR sum(e - s + 1) OVER (PARTITION BY query, file) >= n * 0.8 AS whole FROM m),
    win AS (SELECT DISTINCT query, file, whole, CASE WHEN whole THEN 1 ELSE s END AS s, CASE WHEN whole THEN n ELSE e END AS e FROM c),
    gap AS (SELECT query, file, s, lag(e) OVER (PARTITION BY query, file ORDER BY s) AS p FROM win),
    piece AS (
        SELECT query, file, 0 AS ln, 0 AS kind, '**`' || file || '`**' || chr(10) || chr(10) || '```' || chr(10) AS t FROM top
        UNION ALL SELECT query, file, s, 0, '… [lines ' || (p + 1) || '–' || (s - 1) || ' omitted] …' || chr(10) FROM gap WHERE s > p + 1
        UNION ALL SELECT w.query, w.file, line, 1, line || chr(9) || CASE WHEN strlen(text) > 1200 THEN left(text, 1200) || '… [line truncated: ' || strlen(text) || ' bytes]' ELSE text END || chr(10) FROM win w JOIN lines l ON l.file = w.file AND line BETWEEN s AND e
        UNION ALL SELECT query, file, n + 1, 2, '```' || chr(10) || chr(10) FROM top),
    ends AS (SELECT *, sum(strlen(t)) OVER (PARTITION BY query, file ORDER BY ln, kind) AS upto FROM piece),
    size AS (SELECT query, file, rank, max(upto) AS size, any_value(whole) AS whole FROM ends JOIN top USING (query, file) JOIN (SELECT DISTINCT query, file, whole FROM win) USING (query, file) GROUP BY ALL),
    cut AS (SELECT *, rank = 1 AND size // 4 > 1200 AND size > 4800 AS cut FROM size),
    txt AS (SELECT query, file, rank, whole, cut, string_agg(t, '' ORDER BY ln, kind) || CASE WHEN cut THEN '… [cut ' || file || ' here to stay within the budget; read the file for the rest]' || chr(10) || chr(10) ELSE '' END AS t
        FROM ends JOIN cut USING (query, file) WHERE NOT cut OR upto <= 4800 GROUP BY query, file, rank, whole, cut),
    cost AS (SELECT *, greatest(1, strlen(t) // 4) AS cost FROM txt), sp AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM cost),
    stop AS (SELECT query, min(rank) AS stop FROM sp WHERE rank > 1 AND (spent > 600 OR spent + cost > 1200) GROUP BY query),
    shown AS (SELECT sp.* FROM sp LEFT JOIN stop USING (query) WHERE stop IS NULL OR rank < stop) """


@query(_PICKED + """SELECT o.query, o.file, o.rank, CASE WHEN s.file IS NULL THEN 'listed' WHEN cut THEN 'cut' WHEN whole THEN 'whole' ELSE 'windows' END AS state, coalesce(cost, 0) AS cost, sha256(s.t) AS text_sha256
    FROM ord o LEFT JOIN shown s ON s.query = o.query AND s.file = o.file""")
def delivered_text(spark, sf):
    """Source text for a query in each language: lines with a common word are picked, scored by their length."""
    files = A.table(spark, sf, "documents").select(A.document_file().alias("file"), F.coalesce("lang", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("content"))
    hits = text.hits(A.lines(spark, sf), "the").join(files.select("query", "file"), "file")
    size = F.octet_length("text")
    picked = hits.select("query", "file", F.col("line").alias("start"), (F.col("line") + size % 30).alias("end"), (size % 2 == 0).alias("full"), F.lit("dependency").alias("category"), (size % 97).cast("double").alias("score"), F.col("line").alias("pos"))
    got = delivery.deliver(picked, files.select("file", "content"), 600)
    return got.select("query", "file", "rank", "state", "cost", F.sha2("text", 256).alias("text_sha256"))
