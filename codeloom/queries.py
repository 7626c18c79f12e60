"""Queries of the generic operators over ordinary tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as s
from .functions import values as v
from .operators import lines, relational, traversal
from .plans import diff, review, search
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register a function of a table reader under its name."""

    def take(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return take


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_first_wins(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return relational.first_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).drop("l_quantity", "l_extendedprice")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_status_per_user(t):
    return review.latest_status(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""
WITH c AS (SELECT o_orderkey, o_custkey * 7 AS k, 0 AS p FROM orders UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders),
m AS (SELECT o_orderkey, p, s_name FROM c JOIN supplier ON s_suppkey = k)
SELECT o.o_orderkey, min(p) AS matched_priority, arg_min(s_name, p) AS s_name FROM orders o LEFT JOIN m USING (o_orderkey) GROUP BY 1""")
def lookup_by_priority(t):
    candidates = F.array(F.col("o_custkey") * 7, F.col("o_custkey"))
    table = t("supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    return relational.lookup_by_priority(t("orders").select("o_orderkey", "o_custkey"), candidates, table, "key", "s_name", ["o_orderkey"]).select("o_orderkey", "matched_priority", "s_name")


@query("SELECT c_custkey, s_suppkey FROM customer LEFT JOIN (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE 25 + s_suppkey END AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) = 1) ON c_custkey = k")
def unique_match(t):
    key = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey").cast("long")).otherwise(F.col("s_suppkey") + 25)
    return relational.unique_match(t("customer").select("c_custkey"), t("supplier").select(key.alias("c_custkey"), "s_suppkey"), ["c_custkey"], "s_suppkey").select("c_custkey", "s_suppkey")


def _points(t):
    return t("customer").select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 40).alias("at")), t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 30).alias("lo"), (F.col("s_suppkey") % 30 + F.col("s_suppkey") % 7).alias("hi"))


_POINTS = "WITH p AS (SELECT c_custkey, c_nationkey AS k, c_custkey % 40 AS x FROM customer), i AS (SELECT s_suppkey, s_nationkey AS k, s_suppkey % 30 AS lo, s_suppkey % 30 + s_suppkey % 7 AS hi FROM supplier) "


@query(_POINTS + "SELECT c_custkey, s_suppkey FROM p JOIN i ON p.k = i.k AND x BETWEEN lo AND hi")
def interval_all(t):
    points, intervals = _points(t)
    return relational.contained(points, intervals, ["k"], "at", "lo", "hi").select("c_custkey", "s_suppkey")


@query(_POINTS + "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY lo DESC, hi, s_suppkey) AS rn FROM p JOIN i ON p.k = i.k AND x BETWEEN lo AND hi) WHERE rn = 1")
def interval_innermost(t):
    points, intervals = _points(t)
    return relational.innermost(points, intervals, ["k"], "at", "lo", "hi", ["c_custkey"], "s_suppkey").select("c_custkey", "s_suppkey")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_k_per_key(t):
    return relational.top_k(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, running_cost FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_cost FROM lineitem) WHERE running_cost <= 200")
def within_budget(t):
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("cost"))
    return relational.within_budget(rows, "cost", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 200, ["l_suppkey"]).drop("cost", "l_extendedprice")


@query("SELECT user_id, CAST(sum(n) AS BIGINT) AS n, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def nested_histogram(t):
    got = relational.histogram(t("events"), ["user_id"], "event_type")
    return got.withColumn("histogram", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query("SELECT lang, sum(n_chars)::BIGINT AS chars, round(100.0 * sum(n_chars) / sum(sum(n_chars)) OVER (), 1) AS share FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def language_shares(t):
    rows = t("documents").select(F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"))
    return files.language_shares(rows).select(F.col("language").alias("lang"), F.col("bytes").alias("chars"), "share")


@query("""
WITH h AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '.' || p_name AS qualified_name, upper(split_part(p_type, ' ', 1)) AS kind FROM part
  WHERE p_name ILIKE '%al%' OR p_brand || '.' || p_name ILIKE '%al%'),
r AS (SELECT *, CASE WHEN qualified_name = 'al' THEN 6 WHEN qualified_name = name || '.al' THEN 5 WHEN name = 'al' THEN 5 WHEN ends_with(qualified_name, 'al') THEN 4 WHEN starts_with(name, 'al') THEN 3
  WHEN lower(name) = 'al' THEN 3 WHEN starts_with(lower(name), 'al') THEN 2 WHEN contains(lower(name), 'al') THEN 1 ELSE 0 END AS score FROM h)
SELECT symbol_id, name, qualified_name, kind, p.p_brand AS path, score FROM r JOIN part p ON p_partkey = symbol_id ORDER BY score DESC, lower(name) DESC, path DESC, symbol_id DESC LIMIT 50""")
def ranked_symbol_search(t):
    part = t("part")
    symbols = part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.upper(F.split("p_type", " ")[0]).alias("kind"))
    return search.search_symbols(symbols, part.select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("path")), "al", limit=50)


@query("""
WITH h AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id AS path FROM documents WHERE source || '/' || lang || '/' || doc_id ILIKE '%en/1%')
SELECT file_id, path, CASE WHEN path = 'en/1' THEN 6 WHEN starts_with(path, 'en/1/') THEN 5 WHEN ends_with(path, 'en/1') THEN 4 WHEN contains(path, 'en/1') THEN 2 ELSE 0 END AS score,
  coalesce((SELECT count(*) FROM labels l WHERE l.doc_id = file_id), 0) AS symbol_count FROM h ORDER BY score DESC, path DESC, file_id DESC LIMIT 40""")
def ranked_file_search(t):
    files = t("documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return search.search_files(files, t("labels").select(F.col("doc_id").alias("file_id")), "en/1", limit=40)


@query("""
WITH f AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, text FROM documents),
l AS (SELECT path, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line, unnest(range(1, len(string_split_regex(text, '\\r\\n|\\n|\\r')) + 1)) AS line_number FROM f)
SELECT path, line_number::INT AS line_number, substr(trim(line), 1, 220) AS snippet FROM l WHERE contains(lower(line), 'idiot') ORDER BY path, line_number LIMIT 100""")
def text_search(t):
    files = t("documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size_bytes"))
    return search.search_text(files, "idiot", limit=100)


@query("""
WITH e AS (SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem), d AS (SELECT a AS source, b AS target FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT 'P' || p_partkey AS node FROM part WHERE p_size = 1),
n1 AS (SELECT target AS node, min(source) AS via_source FROM d JOIN r ON source = node WHERE target NOT IN (SELECT node FROM r) GROUP BY 1),
n2 AS (SELECT target AS node, min(struct_pack(v := n1.via_source, s := source)) AS m FROM d JOIN n1 ON source = n1.node WHERE target NOT IN (SELECT node FROM r) AND target NOT IN (SELECT node FROM n1) GROUP BY 1)
SELECT node, 0 AS depth, 0 AS steps FROM r UNION ALL SELECT node, 1, 1 FROM n1 UNION ALL SELECT node, 2, 2 FROM n2""")
def bounded_traversal(t):
    pairs = t("lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("source"), F.concat(F.lit("S"), "l_suppkey").alias("target"))  # repeated edges find nothing new
    edges = pairs.union(pairs.select("target", "source")).withColumn("kind", F.lit("SUPPLIES"))
    roots = t("part").where("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.lpad(F.col("p_partkey").cast("string"), 20, "0").alias("rank"))
    return traversal.bounded_bfs(roots, edges, 2).select("node", "depth", F.size("path").alias("steps"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{v.SECRET_ASSIGNMENT.replace(chr(39), chr(39) * 2)}', '\\1=REDACTED', 'g')) AS redacted FROM documents")
def redacted_texts(t):
    return t("documents").select("doc_id", F.md5(s.redact_secret(F.col("text"))).alias("redacted"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(line, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1)) AS name FROM l)
SELECT doc_id, count(*) AS n, count(DISTINCT name) AS names FROM w WHERE length(name) >= 2 GROUP BY 1""")
def identifiers_per_document(t):
    found = lines.identifiers(lines.lines(t("documents").select("doc_id", F.col("text").alias("content"))))
    each = found.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("c"))  # two steps, so that no task expands rows for the distinct count
    return each.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("names"))


@query("""
WITH b AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents), a AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'n' ELSE 'd' END || doc_id AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents),
j AS (SELECT coalesce(b.path, a.path) AS path, b.h AS old, a.h AS new FROM b FULL JOIN a ON a.path = b.path WHERE b.h IS DISTINCT FROM a.h),
r AS (SELECT x.path, y.old_path FROM (SELECT new AS h, min(path) AS path FROM j WHERE old IS NULL GROUP BY 1) x JOIN (SELECT old AS h, min(path) AS old_path FROM j WHERE new IS NULL GROUP BY 1) y USING (h))
SELECT path, CASE WHEN old IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS status, NULL AS old_path FROM j WHERE path NOT IN (SELECT path FROM r) AND path NOT IN (SELECT old_path FROM r)
UNION ALL SELECT path, 'RENAMED', old_path FROM r""")
def snapshot_diff(t):
    docs = t("documents")
    base = docs.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    head = docs.select(F.concat(F.when(F.col("doc_id") % 7 == 0, "n").otherwise("d"), "doc_id").alias("path"), F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return diff.snapshot_diff(base, head).drop("file_category")


@query("SELECT p_partkey, p_brand, coalesce(o.status, 'OPEN') AS status FROM part LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY 1) o ON o_custkey = p_partkey")
def state_carry_over(t):
    old = t("orders").groupBy(F.col("o_custkey").alias("p_partkey")).agg(F.max("o_orderstatus").alias("status"))
    return relational.carried_over(t("part").select("p_partkey", "p_brand"), old, "p_partkey", {"status": "OPEN"})


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey)")
def absent_rows(t):
    return relational.absent(t("part").select("p_partkey", "p_name"), t("customer").select(F.col("c_custkey").alias("p_partkey")), ["p_partkey"])


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS lines FROM documents")
def line_counts(t):
    return t("documents").select("doc_id", s.line_count(F.col("text")).alias("lines"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_orders(t):
    return relational.page(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25, 50)
