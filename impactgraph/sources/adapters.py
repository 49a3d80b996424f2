"""Tables of symbols, edges, lines, reads and changes, derived from the star schema, events and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that recency counts from.
NOW = "2001-12-01"
#: Lines of a block, which is a symbol of its document.
BLOCK = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are functions and suppliers methods of the component that their nation is; households are test files."""
    place = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("dir"))
    place = F.broadcast(place)

    def of(name: str, key: str, nation: str, shown: str, balance: str, prefix: str, kind: str, file):
        t = table(spark, sf, name).join(place, F.col(nation) == F.col("n_nationkey"))
        return t.select(
            F.concat(F.lit(prefix), F.col(key)).alias("id"), F.concat(F.col("dir"), file).alias("file_path"), F.lit(kind).alias("kind"), F.col(shown).alias("name"), F.lit("").alias("qualified_name"),
            (F.col(balance) >= 0).alias("exports"), (F.col(key) * 10 + 1).cast("int").alias("start"), (F.col(key) * 10 + 8).cast("int").alias("end"),
        )

    suffix = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "/customer_test.src").otherwise("/customer.src")
    return of("customer", "c_custkey", "c_nationkey", "c_name", "c_acctbal", "c:", "function", suffix).unionByName(of("supplier", "s_suppkey", "s_nationkey", "s_name", "s_acctbal", "s:", "method", F.lit("/supplier.src")))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """One edge for each order line between nations that the key rule joins; some targets aren't indexed."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    a, b = F.broadcast(nation.select(F.col("n_nationkey").alias("na"), F.col("n_regionkey").alias("ra"))), F.broadcast(nation.select(F.col("n_nationkey").alias("nb"), F.col("n_regionkey").alias("rb")))
    sold = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.join(a, F.col("c_nationkey") == F.col("na")).join(b, F.col("s_nationkey") == F.col("nb")).where("(na * 7 + nb * 11) % 5 < 2 AND ra <= rb")
    return sold.select(
        F.concat(F.lit("c:"), F.col("o_custkey")).alias("src"),
        F.concat(F.when(F.col("l_suppkey") % 17 == 0, "ext:").otherwise("s:"), F.col("l_suppkey")).alias("dst"),
        F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "uses-type").otherwise("imports").alias("type"),
        F.when(F.col("l_tax") >= 0.07, "heuristic").when(F.col("l_linestatus") == "O", "native").otherwise("astkit").alias("source"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


def document_file() -> F.Column:
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """file, content."""
    return table(spark, sf, "documents").select(document_file().alias("file"), F.coalesce("text", F.lit("")).alias("content"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """file, line (from 1), text."""
    return split_lines(files(spark, sf))


def split_lines(files: DataFrame) -> DataFrame:
    at = files.select("file", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    return at.select("file", (F.col("at") + 1).alias("line"), "text")


def blocks(lines: DataFrame) -> DataFrame:
    """Symbols of documents: every BLOCK lines, and the whole document around them."""
    size = lines.groupBy("file").agg(F.max("line").alias("n"))
    whole = size.select("file", F.concat("file", F.lit("::all")).alias("id"), F.lit(1).alias("start"), F.col("n").alias("end"))
    part = size.select("file", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(BLOCK))).alias("start"))
    part = part.select("file", F.concat("file", F.lit("::b"), F.col("start")).alias("id"), "start", F.least(F.col("start") + BLOCK - 1, "n").alias("end"))
    return whole.unionByName(part)


def touches(spark: SparkSession, sf: str) -> DataFrame:
    """ts, file: each order line is a change of its part."""
    return table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), F.concat(F.lit("part/"), F.col("l_partkey")).alias("file"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """session, file, content_hash, ts, seq, tokens: events as a log of reads; contents change every ten days."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("session"), F.col("event_type").alias("file"), F.floor(F.dayofyear("ts") / 10).cast("long").alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), F.floor(F.coalesce("value", F.lit(0.0)) * 10).cast("long").alias("tokens"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "system", "exploration").when(F.col("role") == "assistant", "implementation").otherwise("")
    return c.select("conv_id", "turn", "role", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("content"))


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts before and after a change: some renamed, removed, edited, and added. file, name, signature, body."""
    p = table(spark, sf, "part")
    row = ["p_brand", "p_name", "p_type", "p_retailprice", "p_partkey"]
    base = p.select(*row)
    kept = p.where("p_partkey % 11 <> 0")
    name = F.when(F.col("p_partkey") % 13 == 0, F.concat("p_name", F.lit(" renamed"))).otherwise(F.col("p_name"))
    price = F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    kind = F.when(F.col("p_partkey") % 35 == 0, F.concat("p_type", F.lit("*"))).otherwise(F.col("p_type"))
    head = kept.select("p_brand", name.alias("p_name"), kind.alias("p_type"), price.alias("p_retailprice"), "p_partkey")
    new = p.where("p_partkey % 50 = 0").select("p_brand", "p_name", "p_type", "p_retailprice", (F.col("p_partkey") + 10_000_000).alias("p_partkey"))

    def shaped(d: DataFrame) -> DataFrame:
        return d.select(F.col("p_brand").alias("file"), F.concat_ws("#", "p_name", "p_partkey").alias("name"), F.col("p_type").alias("signature"), F.concat_ws("|", F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)")).alias("body"))

    return shaped(base), shaped(head.unionByName(new))


def changed(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """file, start, end: lines 1 to 3 of every fifth document."""
    return docs.where("doc_id % 5 = 0").select(document_file().alias("file"), F.lit(1).alias("start"), F.lit(3).alias("end"))


#: The derivations above as SQL, for the queries' oracles.
SQL = {
    "symbols": """SELECT 'c:' || c_custkey AS id, r_name || '/' || n_name || '/customer' || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '_test' ELSE '' END || '.src' AS file_path, 'function' AS kind, c_name AS name,
            c_acctbal >= 0 AS exports, CAST(c_custkey * 10 + 1 AS INTEGER) AS "start", CAST(c_custkey * 10 + 8 AS INTEGER) AS "end", r_name || '/' || n_name AS comp, r_name AS region, c_mktsegment = 'HOUSEHOLD' AS test
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 's:' || s_suppkey, r_name || '/' || n_name || '/supplier.src', 'method', s_name, s_acctbal >= 0, CAST(s_suppkey * 10 + 1 AS INTEGER), CAST(s_suppkey * 10 + 8 AS INTEGER), r_name || '/' || n_name, r_name, FALSE
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "edges": """SELECT 'c:' || o_custkey AS src, CASE WHEN l_suppkey % 17 = 0 THEN 'ext:' ELSE 's:' END || l_suppkey AS dst,
            CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'uses-type' ELSE 'imports' END AS type,
            CASE WHEN l_tax >= 0.07 THEN 'heuristic' WHEN l_linestatus = 'O' THEN 'precise' ELSE 'measured' END AS tier, 1 - l_discount AS confidence
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey
        WHERE (a.n_nationkey * 7 + b.n_nationkey * 11) % 5 < 2 AND a.n_regionkey <= b.n_regionkey""",
    "lines": """SELECT file, unnest(range(1, len(t) + 1)) AS line, unnest(t) AS text
        FROM (SELECT concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id AS VARCHAR)) AS file, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)""",
    "blocks": f"""SELECT file, file || '::all' AS id, 1 AS "start", n AS "end" FROM (SELECT file, max(line) AS n FROM lines GROUP BY file)
        UNION ALL SELECT file, file || '::b' || s, s, least(s + {BLOCK} - 1, n) FROM (SELECT file, n, unnest(range(1, n + 1, {BLOCK})) AS s FROM (SELECT file, max(line) AS n FROM lines GROUP BY file))""",
    "touches": "SELECT l_shipdate AS ts, 'part/' || l_partkey AS file FROM lineitem",
    "reads": "SELECT user_id AS session, event_type AS file, CAST(floor(dayofyear(ts) / 10) AS BIGINT) AS content_hash, ts, event_id AS seq, CAST(floor(coalesce(value, 0.0) * 10) AS BIGINT) AS tokens FROM events",
    "turns": "SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 'exploration' WHEN 'assistant' THEN 'implementation' ELSE '' END AS kind, coalesce(text, '') AS content FROM conversations",
    "base": "SELECT p_brand AS file, p_name || '#' || p_partkey AS name, p_type AS signature, p_partkey || '|' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS body FROM part",
    "head": """SELECT p_brand AS file, p_name || CASE WHEN p_partkey % 13 = 0 THEN ' renamed' ELSE '' END || '#' || p_partkey AS name, p_type || CASE WHEN p_partkey % 35 = 0 THEN '*' ELSE '' END AS signature,
            p_partkey || '|' || CAST(CAST(p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS VARCHAR) AS body FROM part WHERE p_partkey % 11 <> 0
        UNION ALL SELECT p_brand, p_name || '#' || (p_partkey + 10000000), p_type, (p_partkey + 10000000) || '|' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) FROM part WHERE p_partkey % 50 = 0""",
    "changed": "SELECT concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id AS VARCHAR)) AS file, 1 AS \"start\", 3 AS \"end\" FROM documents WHERE doc_id % 5 = 0",
}


def with_tables(*names: str) -> str:
    """A WITH clause of these derivations; `blocks` needs `lines`."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "
