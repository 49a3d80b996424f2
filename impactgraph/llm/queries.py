"""The registered queries of the corpus operators, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactgraph.llm import decontaminate, exact_dedup, filter_audit, hard_negatives, language, line_dedup, mixture, ngram_join, substring_dedup, suffix_dedup, telephony, token_files, tokens
from impactgraph.llm.common import Scratch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_check(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_units", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(table(spark, sf_dir, "documents"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixture.copies(table(spark, sf_dir, "documents"))
    return got.select("doc.doc_id", F.col("__domain").alias("domain"), F.col("__tokens").alias("n_tokens"), F.col("__copies").alias("copies"))


#: Documents that the language model must not learn from.
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 4) = 2"


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs, where=f"NOT ({HELD_OUT})"), HELD_OUT)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), n=4, percent=85)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.features(telephony.stored(table(spark, sf_dir, "documents"), Scratch(spark, "telephony")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_binary, op2_exact_dedup, op3_token_counts, op4_line_dedup, op5_suffix_dedup, op6_substring_dedup, op7_mixture, op8_language, op9_ngram_join, op10_decontaminate, op11_filter_audit, op12_hard_negatives, op13_telephony)}

_WHITE = r"[\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op4_line_dedup": r"""
        WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, u, ls[u] AS line, string_split(ls[u], ' ') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS u FROM s)),
        e AS (SELECT doc_id, u, line, w, len(w) AS n, {'d': doc_id, 'u': u} AS pos FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        v AS (SELECT pos, n, i, array_to_string(list_slice(w, 1, i - 1) || list_slice(w, i + 1, n), ' ') AS key FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM e WHERE n >= 8)),
        same AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY line) AS least FROM e) WHERE least < pos),
        swap AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, i, key) AS least FROM v) WHERE least < pos),
        short AS (SELECT line AS key, min(pos) AS least FROM e WHERE n >= 8 GROUP BY line),
        long AS (SELECT key, min(pos) AS least FROM v WHERE n >= 9 GROUP BY key),
        drop_ AS (SELECT v.pos FROM v JOIN short USING (key) WHERE v.n >= 9 AND short.least < v.pos),
        add_ AS (SELECT e.pos FROM e JOIN long ON e.line = long.key WHERE e.n >= 8 AND long.least < e.pos),
        gone AS (SELECT pos.d AS doc_id, pos.u AS u FROM (SELECT * FROM same UNION SELECT * FROM swap UNION SELECT * FROM drop_ UNION SELECT * FROM add_)),
        kept AS (SELECT l.doc_id, count(*) FILTER (gone.u IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY l.u) FILTER (gone.u IS NULL) AS text FROM l LEFT JOIN gone USING (doc_id, u) GROUP BY l.doc_id)
        SELECT s.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_units, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM s LEFT JOIN kept USING (doc_id)""",
    "op5_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
        g AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
        m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS times FROM g) WHERE times > 1),
        o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM m),
        k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM o),
        sp AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM k GROUP BY doc_id, island),
        q AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM sp),
        r AS (SELECT q.doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head, max(e) AS last FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN last IS NULL THEN x ELSE coalesce(head, '') || substr(x, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
                 FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM g) WHERE least < doc_id),
        per AS (SELECT doc_id, list(p) AS ps, count(*) AS n_removed FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(array_to_string(CASE WHEN n_removed IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN per USING (doc_id)""",
    "op7_mixture": """
        WITH d AS (
            SELECT doc_id, text, CASE WHEN right(coalesce(source, ''), 1) IN ('0', '1', '2') THEN 'web' WHEN right(coalesce(source, ''), 1) IN ('3', '4', '5') THEN 'books' ELSE 'other' END AS domain,
                   coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, strlen(text) // 4) END AS n_tokens
            FROM documents),
        leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, 2.0::DOUBLE * sum(n_tokens) AS cap, 1.0::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
        n1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 6.0::DOUBLE WHEN 'books' THEN 3 ELSE 1 END AS w, (SELECT floor(sum(tokens) * 0.6::DOUBLE) FROM leaf)::DOUBLE AS budget FROM leaf GROUP BY domain),
        l1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n1),
        c1 AS (SELECT max(level) FILTER (cap / w > level) AS cut FROM l1),
        b1 AS (SELECT domain, CASE WHEN cut IS NULL OR cap / w <= level THEN cap ELSE w * cut END AS budget FROM l1, c1),
        n2 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, any_value(b1.budget) AS budget FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang),
        l2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n2),
        c2 AS (SELECT domain, max(level) FILTER (cap / w > level) AS cut FROM l2 GROUP BY domain),
        b2 AS (SELECT domain, lang, CASE WHEN cut IS NULL OR cap / w <= level THEN cap ELSE w * cut END AS budget FROM l2 JOIN c2 USING (domain)),
        l3 AS (SELECT leaf.*, budget, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM leaf JOIN b2 USING (domain, lang)),
        c3 AS (SELECT domain, lang, max(level) FILTER (cap / w > level) AS cut FROM l3 GROUP BY domain, lang),
        b3 AS (SELECT domain, lang, source, tokens, floor(CASE WHEN cut IS NULL OR cap / w <= level THEN cap ELSE w * cut END)::BIGINT AS budget FROM l3 JOIN c3 USING (domain, lang)),
        o AS (SELECT d.*, budget // tokens AS whole, budget % tokens AS rest, md5('11:' || (budget // tokens) || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM d LEFT JOIN b3 USING (domain, lang, source))
        SELECT doc_id, domain, n_tokens, CAST(coalesce(whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(h, 1, 15), doc_id, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END, 0) AS BIGINT) AS copies
        FROM o""",
    "op9_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
        e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
        r AS (SELECT u AS x, u AS y FROM e UNION SELECT r.x, e.v FROM r JOIN e ON r.y = e.u),
        c AS (SELECT x, min(y) AS least_ FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id""",
    "op10_decontaminate": r"""
        WITH dw AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
        bw AS (
            SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark),
        bg AS (
            SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM bg),
        hit AS (
            SELECT d.doc_id, d.i, d.k, b.item_id
            FROM (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
                  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw CROSS JOIN ks WHERE len(w) >= k)) d
            JOIN bg b ON b.k = d.k AND b.g = d.g),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
        d AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::INT
                   + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
            FROM t LEFT JOIN l USING (doc_id)),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (
            SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
        s AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(list_slice(bits, 1, i - 1)), 0)::INT AS earlier FROM (SELECT *, unnest(range(1, 6)) AS i FROM o)),
        m AS (SELECT part, mask, good, toxic, count(*) AS n FROM d GROUP BY ALL),
        r AS (
            SELECT part, filter_order, step, bit,
                   coalesce(sum(n) FILTER (mask & (bit | earlier) = 0), 0) AS kept,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0) AS removed,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0) AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0 AND good), 0) AS good_lost,
                   coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0 AND toxic), 0) AS toxic_lost
            FROM m CROSS JOIN s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM r""",
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (
            SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
