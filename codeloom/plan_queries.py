"""Queries of the plans over a repository made of the ordinary tables, each with its DuckDB SQL.

Parts are files, orders are symbols, lineitems are relationships; customers, suppliers and events stand for changes, checklists
and logs. The SQL states the same tables in ``MADE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import scalar as s
from .operators import lines, relational, traversal
from .plans import context, diff, extract, impact, listing, resolve, review, search, views
from .queries import query
from .sources import files as sources

MADE = """
WITH files AS (SELECT p_partkey AS file_id, 1 + p_partkey % 3 AS repository_id, CASE p_partkey % 4 WHEN 0 THEN 'TypeScript' ELSE 'Python' END AS language, p_size * 100 AS size_bytes,
  'src/pkg' || p_partkey % 5 || '/' || CASE WHEN p_partkey % 9 = 0 THEN 'test_' ELSE '' END || 'm' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.ts' ELSE '.py' END AS path FROM part),
symbols AS (SELECT o_orderkey AS symbol_id, 1 + o_custkey % 150 AS file_id, 'f' || o_orderkey % 97 AS name, 'm.f' || o_orderkey % 97 AS qualified_name,
  CASE o_orderkey % 5 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'IMPORT' WHEN 2 THEN 'METHOD' ELSE 'FUNCTION' END AS kind, (1 + o_orderkey % 90)::INT AS line_start, (1 + o_orderkey % 90 + o_custkey % 20)::INT AS line_end,
  CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey - 2 END AS parent_symbol_id, o_orderkey % 2 = 0 AS exported FROM orders),
raw AS (SELECT l_linenumber % 6 AS t, l_suppkey % 5 AS u, l_orderkey, l_partkey, l_suppkey, l_quantity::INT AS q, l_returnflag || l_linestatus AS evidence FROM lineitem),
edges AS (SELECT CASE WHEN t IN (2, 4) THEN NULL ELSE l_orderkey END AS source_symbol_id, CASE WHEN u > 1 AND l_partkey % 8 != 0 THEN 1 + l_partkey * 7 % 1500 END AS target_symbol_id,
  ['CALLS', 'REFERENCES', 'IMPORTS', 'EXTENDS', 'TESTS', 'DEFINES'][t + 1] AS type, CASE u WHEN 0 THEN 'EXTERNAL' WHEN 1 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status,
  CASE WHEN t IN (2, 4) THEN 'FILE' ELSE 'SYMBOL' END AS source_type, 'SYMBOL' AS target_type, 1 + l_partkey % 150 AS evidence_file_id, q AS start_line, q AS end_line, evidence,
  CASE WHEN u > 1 AND l_partkey % 8 = 0 THEN 1 + l_suppkey % 150 END AS target_file_id FROM raw)
"""


def made_files(t) -> DataFrame:
    key = F.col("p_partkey")
    script = key % 4 == 0
    path = F.concat(F.lit("src/pkg"), (key % 5).cast("string"), F.lit("/"), F.when(key % 9 == 0, "test_").otherwise(""), F.lit("m"), key.cast("string"), F.when(script, ".ts").otherwise(".py"))
    return t("part").select(key.alias("file_id"), (1 + key % 3).alias("repository_id"), F.when(script, "TypeScript").otherwise("Python").alias("language"), (F.col("p_size") * 100).alias("size_bytes"), path.alias("path"))


def made_symbols(t) -> DataFrame:
    key, five = F.col("o_orderkey"), F.col("o_orderkey") % 5
    name = F.concat(F.lit("f"), (key % 97).cast("string"))
    kind = F.when(five == 0, "CLASS").when(five == 1, "IMPORT").when(five == 2, "METHOD").otherwise("FUNCTION")
    return t("orders").select(
        key.alias("symbol_id"), (1 + F.col("o_custkey") % 150).alias("file_id"), name.alias("name"), F.concat(F.lit("m."), name).alias("qualified_name"), kind.alias("kind"),
        (1 + key % 90).cast("int").alias("line_start"), (1 + key % 90 + F.col("o_custkey") % 20).cast("int").alias("line_end"), F.when(five == 2, key - 2).alias("parent_symbol_id"), (key % 2 == 0).alias("exported"),
    )


def made_edges(t) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 6).alias("t"), (F.col("l_suppkey") % 5).alias("u"), F.col("l_quantity").cast("int").alias("q"), F.concat("l_returnflag", "l_linestatus").alias("evidence"))
    by_file, inside = F.col("t").isin(2, 4), F.col("u") > 1
    kinds = F.array(*[F.lit(x) for x in ("CALLS", "REFERENCES", "IMPORTS", "EXTENDS", "TESTS", "DEFINES")])
    whole = F.col("l_partkey") % 8 == 0
    return rows.select(
        F.when(~by_file, F.col("l_orderkey")).alias("source_symbol_id"), F.when(inside & ~whole, 1 + F.col("l_partkey") * 7 % 1500).alias("target_symbol_id"), F.get(kinds, F.col("t")).alias("type"),
        F.when(F.col("u") == 0, "EXTERNAL").when(F.col("u") == 1, "UNRESOLVED").otherwise("RESOLVED").alias("status"), F.when(by_file, "FILE").otherwise("SYMBOL").alias("source_type"), F.lit("SYMBOL").alias("target_type"),
        (1 + F.col("l_partkey") % 150).alias("evidence_file_id"), F.col("q").alias("start_line"), F.col("q").alias("end_line"), "evidence", F.when(inside & whole, 1 + F.col("l_suppkey") % 150).alias("target_file_id"),
    )


# --- scalar rules, by templates of which the SQL states the outcome

_PATHS = [
    ("src/a{n}/__init__.py", "src.a{n}", "a{n}", "Python", "python", "SOURCE", False, False),
    ("lib/b{n}.ts", "lib.b{n}", "b{n}", "TypeScript", "typescript", "SOURCE", False, False),
    ("tests/test_{n}.py", "tests.test_{n}", "tests.test_{n}", "Python", "python", "TEST", True, False),
    ("docs/guide{n}.md", "docs.guide{n}", "docs.guide{n}", None, None, "DOCUMENTATION", False, False),
    ("setup.py", "setup", "setup", "Python", "python", "CONFIG", False, False),
    (".github/w{n}.yml", ".github.w{n}", ".github.w{n}", None, None, "CONFIG", False, False),
    ("pkg/x{n}.test.tsx", "pkg.x{n}.test", "pkg.x{n}.test", "TypeScript", "tsx", "TEST", True, False),
    ("node_modules/q{n}/i.js", "node_modules.q{n}.i", "node_modules.q{n}.i", "JavaScript", "javascript", "SOURCE", False, True),
    ("a/b/c{n}.md", "a.b.c{n}", "a.b.c{n}", None, None, "UNKNOWN", False, False),
    ("data{n}.bin", "data{n}", "data{n}", None, None, "UNKNOWN", False, False),
    ("python/site{n}/mod.jsx", "python.site{n}.mod", "site{n}.mod", "JavaScript", "jsx", "SOURCE", False, False),
    ("w/__tests__/y{n}.js", "w.__tests__.y{n}", "w.__tests__.y{n}", "JavaScript", "javascript", "TEST", False, False),
]


def _sql(value) -> str:
    if isinstance(value, str):
        return "replace('" + value.replace("'", "''") + "', '{n}', p_partkey::VARCHAR)"
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else str(value)


def _by_template(templates: list[tuple], names: list[str]) -> str:
    cases = [f"CASE p_partkey % {len(templates)} " + " ".join(f"WHEN {i} THEN {_sql(row[k])}" for i, row in enumerate(templates)) + f" END AS {name}" for k, name in enumerate(names)]
    return f"SELECT p_partkey, {', '.join(cases)} FROM part"


def _templated(t, templates: list[tuple], k: int = 0):
    """p_partkey and the ``k``-th text of its template."""
    texts = F.array(*[F.lit(row[k]) for row in templates])
    return t("part").select("p_partkey", F.replace(F.get(texts, F.col("p_partkey") % len(templates)), F.lit("{n}"), F.col("p_partkey").cast("string")).alias("x"))


@query(_by_template(_PATHS, ["path", "module", "layout_module", "language", "parse_language", "category", "test_file", "ignored"]))
def path_rules(t):
    path = F.col("x")
    language = s.language_of(path)
    return _templated(t, _PATHS).select("p_partkey", path.alias("path"), s.module_of_path(path).alias("module"), s.layout_module(s.module_of_path(path)).alias("layout_module"), language.alias("language"), s.parse_language(language, path).alias("parse_language"), s.file_category(path).alias("category"), s.is_test_file(path).alias("test_file"), s.is_ignored(path).alias("ignored"))


_URLS = [
    ("https://github.com/o{n}/r.git", "o{n}", "r"), ("https://www.github.com/own/rep{n}", "own", "rep{n}"), ("http://github.com/a/b", None, None), ("https://github.com/a", None, None),
    ("https://example.org/a/b", None, None), ("https://github.com/a/b?x={n}", None, None), ("https://github.com/a/b/c", None, None),
]


@query(_by_template(_URLS, ["url", "owner", "name"]))
def repository_urls(t):
    return _templated(t, _URLS).withColumn("r", s.repository_of(F.col("x"))).select("p_partkey", F.col("x").alias("url"), "r.owner", "r.name")


_DIFF_NAMES = [("main", True, "a/{x => y}/z{n}", "a/y/z{n}", "A", "ADDED"), ("-x", False, "old => new{n}", "new{n}", "R100", "RENAMED"), ("a..b", False, "same{n}", "same{n}", "M", "MODIFIED"), ("v1.{n}~2", True, "a/{ => b}/c", "a/b/c", "D", "DELETED"), ("a b", False, "{a => b}.py", "b.py", "C75", "COPIED"), ("HEAD^", True, "q", "q", "T", "MODIFIED"), ("", False, "q", "q", "X", "MODIFIED")]


@query(_by_template(_DIFF_NAMES, ["revision", "valid", "written", "path", "code", "status"]))
def revision_and_diff_names(t):
    rows = _templated(t, _DIFF_NAMES).withColumnRenamed("x", "revision")
    for k, name in ((2, "written"), (4, "code")):
        rows = rows.join(_templated(t, _DIFF_NAMES, k).withColumnRenamed("x", name), "p_partkey")
    return rows.select("p_partkey", "revision", s.revision_is_valid(F.col("revision")).alias("valid"), "written", s.numstat_path(F.col("written")).alias("path"), "code", s.diff_status(F.col("code")).alias("status"))


_SECRETS = [
    ("api_key = 'k{n}'", "api_key=REDACTED", "api_key=REDACTED", True), ("PASSWORD:hunter{n}; rest", "PASSWORD=REDACTED; rest", "PASSWORD=REDACTED; rest", True), ("nothing here {n}", "nothing here {n}", "nothing here {n}", False),
    ("Cookie: c{n}", "Cookie: c{n}", "Cookie=REDACTED", False), ("my token=abc, x", "my token=REDACTED, x", "my token=abc, x", True),
]


@query(_by_template(_SECRETS, ["text", "redacted", "log_line", "secret_key"]))
def redaction_rules(t):
    x = F.col("x")
    return _templated(t, _SECRETS).select("p_partkey", x.alias("text"), s.redact_text(F.concat(x, F.lit("\x01"))).alias("redacted"), s.redact_log_line(x).alias("log_line"), s.is_secret_key(x).alias("secret_key"))


_TEXTS = [("  one \n two{n} \nthree", "one two{n} three", " two{n} \nthree", None), ('x {"a": {n}} y', 'x {"a": {n}} y', "", '{"a": {n}}'), ("a\nb\nc\nd{n}", "a b c d{n}", "b\nc", None), ("```json\n{\n}\n```", "```json { } ```", "{\n}", "{\n}")]


@query(_by_template(_TEXTS, ["text", "cleaned", "lines_2_3", "json"]).replace(" FROM part", ", sha256('{\"b\":' || p_partkey || '}') AS digest, CASE WHEN p_partkey > 200 THEN format('Showing the first 200 of {} entries.', p_partkey) ELSE '' END AS note FROM part"))
def text_pieces(t):
    x = F.col("x")
    return _templated(t, _TEXTS).select("p_partkey", x.alias("text"), s.clean_line(x, 40).alias("cleaned"), s.snippet(x, F.lit(2), F.lit(3)).alias("lines_2_3"), s.json_in(x).alias("json"), s.digest(b=F.col("p_partkey")).alias("digest"), review.cap_note(F.col("p_partkey")).alias("note"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, type, CASE type WHEN 'TESTS' THEN 0 WHEN 'CALLS' THEN 1 WHEN 'REFERENCES' THEN 2 WHEN 'EXTENDS' THEN 3 WHEN 'IMPLEMENTS' THEN 4 WHEN 'IMPORTS' THEN 5 ELSE 100 END AS edge_rank,
CASE WHEN item IN ('CHANGED_CODE', 'AFFECTED_TEST', 'CONFIGURATION_CHANGE') THEN 'REQUIRED' WHEN item = 'AFFECTED_CALLER' THEN CASE WHEN l_quantity > 20 AND type IN ('CALLS', 'REFERENCES', 'EXTENDS', 'IMPLEMENTS') THEN 'REQUIRED' ELSE 'RECOMMENDED' END WHEN item = 'DOCUMENTATION_CHANGE' THEN 'INFORMATIONAL' ELSE 'RECOMMENDED' END AS priority,
CASE WHEN l_quantity > 20 AND l_linenumber > 3 THEN 'MODIFIED' WHEN l_quantity > 20 THEN 'ADDED' WHEN l_linenumber > 3 THEN 'DELETED' ELSE 'MODIFIED' END AS change
FROM (SELECT *, ['TESTS', 'CALLS', 'REFERENCES', 'EXTENDS', 'IMPLEMENTS', 'IMPORTS', 'DEFINES'][l_partkey % 7 + 1] AS type, ['CHANGED_CODE', 'AFFECTED_CALLER', 'AFFECTED_TEST', 'DOCUMENTATION_CHANGE', 'UNRESOLVED_IMPACT'][l_suppkey % 5 + 1] AS item FROM lineitem)""")
def rank_rules(t):
    pick = lambda names, key: F.get(F.array(*[F.lit(x) for x in names]), F.col(key) % len(names))
    rows = t("lineitem").withColumn("type", pick(("TESTS", "CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "IMPORTS", "DEFINES"), "l_partkey")).withColumn("item", pick(("CHANGED_CODE", "AFFECTED_CALLER", "AFFECTED_TEST", "DOCUMENTATION_CHANGE", "UNRESOLVED_IMPACT"), "l_suppkey"))
    many, late = (F.col("l_quantity") > 20).cast("int"), (F.col("l_linenumber") > 3).cast("int")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "type", s.edge_priority(F.col("type")).alias("edge_rank"), s.item_priority(F.col("item"), F.col("type"), many == 1).alias("priority"), s.change_type(many, late).alias("change"))


# --- texts: hunks and calls

_HUNK = "'@@ -' || 3 * n || ',2 +' || 4 * n || ',3 @@ f' || chr(10) || ' a' || chr(10) || '-b' || n || chr(10) || '+c' || chr(10) || '+++d' || chr(10)"


@query("""
WITH n AS (SELECT DISTINCT o_orderkey, l_linenumber AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey), h AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n) AS hunk FROM n)
SELECT o_orderkey AS file_id, hunk, 'OLD' AS side, (3 * n + 1)::INT AS line_number, 'DELETED' AS change_type, 'b' || n AS text FROM h
UNION ALL SELECT o_orderkey, hunk, 'NEW', (4 * n + 1)::INT, 'ADDED', 'c' FROM h UNION ALL SELECT o_orderkey, hunk, 'NEW', (4 * n + 2)::INT, 'ADDED', '++d' FROM h""")
def hunk_lines(t):
    numbers = t("lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("n")).join(t("orders").select(F.col("o_orderkey").alias("file_id")), "file_id")
    hunk = lambda n: F.concat(F.lit("@@ -"), (n * 3).cast("string"), F.lit(",2 +"), (n * 4).cast("string"), F.lit(",3 @@ f\n a\n-b"), n.cast("string"), F.lit("\n+c\n+++d\n"))
    diffs = numbers.select("file_id", F.concat(F.lit("--- a/x\n+++ b/x\n"), F.array_join(F.transform("n", hunk), "")).alias("diff"))
    return lines.changed_lines(lines.hunks(diffs, ["file_id"])).select("file_id", "hunk", "side", "line_number", "change_type", "text")


@query("""
WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey AS file_id, 2 AS line_number, 'call' AS kind, a AS name, NULL AS receiver FROM w UNION ALL SELECT p_partkey, 2, 'method', 'run', b FROM w
UNION ALL SELECT p_partkey, 4, 'call', 'go', NULL FROM w UNION ALL SELECT p_partkey, 5, 'call', 'm', NULL FROM w""")
def call_sites_of_lines(t):
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    code = F.concat_ws("\n", F.concat(F.lit("def "), a, F.lit("():")), F.concat(F.lit("    return "), a, F.lit("("), b, F.lit(".run(len(x)))")), F.lit("    # skipped(call)"), F.lit("    if (go (1)): pass"), F.lit("    self.m()"))
    return lines.call_sites(lines.lines(t("part").select(F.col("p_partkey").alias("file_id"), code.alias("content")))).select("file_id", "line_number", "kind", "name", "receiver")


# --- the relationship graph

@query(MADE + """, e AS (SELECT *, CASE type WHEN 'DEFINES' THEN 1 WHEN 'IMPORTS' THEN 2 WHEN 'CALLS' THEN 4 WHEN 'EXTENDS' THEN 5 WHEN 'REFERENCES' THEN 7 ELSE 8 END AS stage FROM edges),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_symbol_id, target_symbol_id, type, status, evidence_file_id, start_line ORDER BY evidence, end_line, target_file_id) AS n FROM e) WHERE n = 1),
c AS (SELECT d.*, repository_id, row_number() OVER (PARTITION BY repository_id ORDER BY stage, evidence_file_id, start_line, source_symbol_id NULLS FIRST, target_symbol_id NULLS FIRST, status) AS place FROM d JOIN files ON file_id = evidence_file_id)
SELECT repository_id, source_symbol_id, target_symbol_id, type, status, evidence_file_id, start_line, evidence FROM c WHERE place <= 1500""")
def edge_dedupe(t):
    edges = made_edges(t).withColumn("target_file_id", F.lit(None).cast("long"))
    return resolve.combined([edges], made_files(t), 1500).select("repository_id", "source_symbol_id", "target_symbol_id", "type", "status", "evidence_file_id", "start_line", "evidence")


@query(MADE + "SELECT type, status, count(*) AS n FROM edges GROUP BY CUBE (type, status)")
def edge_counts(t):
    return resolve.counted(made_edges(t))


@query(MADE + "SELECT CASE WHEN parent_symbol_id IS NULL THEN 'FILE' ELSE 'SYMBOL' END AS source_type, parent_symbol_id AS source_symbol_id, symbol_id AS target_symbol_id, file_id AS evidence_file_id, line_start AS start_line, name AS evidence FROM symbols WHERE kind != 'IMPORT'")
def define_edges(t):
    return resolve.defines(made_symbols(t)).select("source_type", "source_symbol_id", "target_symbol_id", "evidence_file_id", "start_line", "evidence")


_IMPORTS = """, imports AS (SELECT event_id AS import_id, 1 + user_id % 150 AS file_id, CASE event_id % 4 WHEN 0 THEN 'pkg' || event_id % 5 || '.m' || event_id % 200 WHEN 1 THEN 'src.pkg' || event_id % 5 || '.m' || event_id % 200 || '.gone' WHEN 2 THEN '.m' || event_id % 200 ELSE 'outside' END AS source,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'f' || event_id % 97 END AS imported_name FROM events),
m AS (SELECT repository_id, replace(regexp_replace(path, '\\.[a-z]+$', ''), '/', '.') AS module, file_id FROM files), al AS (SELECT repository_id, substr(module, 5) AS module, file_id FROM m),
mods AS (SELECT * FROM m UNION ALL SELECT * FROM al),
tried AS (SELECT import_id, i.file_id, f.repository_id, source, imported_name, CASE WHEN source LIKE '.%' THEN regexp_replace(replace(regexp_replace(f.path, '/[^/]*$', ''), '/', '.') , '$', '') || source ELSE source END AS module FROM imports i JOIN files f ON f.file_id = i.file_id),
hit AS (SELECT tried.*, a.file_id AS f1, b.file_id AS f2 FROM tried LEFT JOIN mods a ON a.repository_id = tried.repository_id AND a.module = tried.module LEFT JOIN mods b ON b.repository_id = tried.repository_id AND b.module = regexp_replace(tried.module, '\\.?[^.]+$', '')),
target AS (SELECT import_id, file_id, source, imported_name, coalesce(f1, f2) AS target_file_id FROM hit)
"""


def made_imports(t) -> DataFrame:
    key = F.col("event_id")
    number, five = (key % 200).cast("string"), (key % 5).cast("string")
    source = F.when(key % 4 == 0, F.concat(F.lit("pkg"), five, F.lit(".m"), number)).when(key % 4 == 1, F.concat(F.lit("src.pkg"), five, F.lit(".m"), number, F.lit(".gone"))).when(key % 4 == 2, F.concat(F.lit(".m"), number)).otherwise("outside")
    return t("events").select(key.alias("import_id"), (1 + F.col("user_id") % 150).alias("file_id"), source.alias("source"), F.when(key % 3 != 0, F.concat(F.lit("f"), (key % 97).cast("string"))).alias("imported_name"), F.lit(None).cast("string").alias("alias"), F.lit("python_from_import").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))


@query(MADE + _IMPORTS + "SELECT import_id, target.target_file_id, s.symbol_id AS target_symbol_id FROM target LEFT JOIN symbols s ON s.file_id = target.target_file_id AND s.name = imported_name")
def import_targets(t):
    return resolve.resolved_imports(made_files(t), made_symbols(t), made_imports(t)).select("import_id", "target_file_id", "target_symbol_id")


@query(MADE + _IMPORTS + """, b AS (SELECT target.file_id, imported_name AS name, import_id, min(symbol_id) AS symbol FROM target JOIN symbols s ON s.file_id = target.target_file_id AND s.name = imported_name GROUP BY 1, 2, 3)
SELECT file_id, name, arg_max(symbol, import_id) AS bound_symbol_id FROM b GROUP BY 1, 2""")
def import_bindings(t):
    return resolve.bindings(resolve.resolved_imports(made_files(t), made_symbols(t), made_imports(t), first=True)).select("file_id", "name", "bound_symbol_id")


@query(MADE + _IMPORTS + """SELECT DISTINCT import_id, CASE WHEN target_file_id IS NOT NULL THEN 'RESOLVED' WHEN source LIKE '.%' THEN 'UNRESOLVED' ELSE 'EXTERNAL' END AS status, concat_ws('.', source, imported_name) AS evidence FROM target""")
def import_status(t):
    found = resolve.resolved_imports(made_files(t), made_symbols(t), made_imports(t))
    return resolve.import_edges(found.withColumn("start_line", F.col("import_id"))).select(F.col("start_line").cast("long").alias("import_id"), "status", "evidence").distinct()


@query(MADE + """, exports AS (SELECT c_custkey AS export_id, 1 + c_custkey % 150 AS file_id, CASE c_custkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'default' ELSE 'f' || c_custkey % 97 END AS name FROM customer),
d AS (SELECT file_id, min(symbol_id) AS target FROM symbols WHERE exported AND kind IN ('CLASS', 'FUNCTION') GROUP BY 1), n AS (SELECT file_id, name, arg_min(symbol_id, (CASE WHEN exported THEN 0 ELSE 1 END) * 1000000000 + symbol_id) AS target FROM symbols GROUP BY 1, 2)
SELECT file_id AS evidence_file_id, export_id::INT AS start_line, NULL AS target_symbol_id FROM exports WHERE name = '*' UNION ALL SELECT e.file_id, export_id::INT, target FROM exports e LEFT JOIN d ON d.file_id = e.file_id WHERE name = 'default'
UNION ALL SELECT e.file_id, export_id::INT, target FROM exports e JOIN n ON n.file_id = e.file_id AND n.name = e.name""")
def export_targets(t):
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, "*").when(key % 5 == 1, "default").otherwise(F.concat(F.lit("f"), (key % 97).cast("string")))
    rows = t("customer").select(key.alias("export_id"), (1 + key % 150).alias("file_id"), name.alias("name"), key.alias("start_line"), key.alias("end_line"))
    return resolve.export_edges(made_files(t), made_symbols(t), rows).select("evidence_file_id", "start_line", "target_symbol_id")


@query(MADE + """, c AS (SELECT s.*, repository_id FROM symbols s JOIN files USING (file_id) WHERE kind = 'CLASS'), w AS (SELECT c.*, 'f' || (symbol_id * 3) % 97 AS base FROM c),
k AS (SELECT w.symbol_id, w.base, (SELECT count(*) FROM c o WHERE o.file_id = w.file_id AND o.name = w.base AND o.symbol_id != w.symbol_id) AS n, (SELECT min(symbol_id) FROM c o WHERE o.file_id = w.file_id AND o.name = w.base AND o.symbol_id != w.symbol_id) AS one,
  (SELECT count(*) FROM c o WHERE o.repository_id = w.repository_id AND o.name = w.base) AS n_all, (SELECT min(symbol_id) FROM c o WHERE o.repository_id = w.repository_id AND o.name = w.base) AS any_one FROM w),
r AS (SELECT symbol_id, base, CASE WHEN n > 1 THEN NULL WHEN n = 1 THEN one WHEN n_all = 1 AND any_one != symbol_id THEN any_one END AS target FROM k)
SELECT symbol_id AS source_symbol_id, target AS target_symbol_id, CASE WHEN target IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status FROM r""")
def base_classes(t):
    symbols = made_symbols(t).withColumn("bases", F.array(F.concat(F.lit("f"), (F.col("symbol_id") * 3 % 97).cast("string"))))
    none = symbols.limit(0).select("file_id", "name", F.col("symbol_id").alias("bound_symbol_id"), F.col("kind").alias("bound_kind"))
    return resolve.extends(made_files(t), symbols, none).select("source_symbol_id", "target_symbol_id", "status")


@query(MADE + "SELECT repository_id, qualified_name, max(symbol_id) AS symbol_id FROM symbols JOIN files USING (file_id) GROUP BY 1, 2")
def qualified_name_index(t):
    return resolve.qualified_names(made_symbols(t).join(made_files(t).select("file_id", "repository_id"), "file_id"), ["repository_id"])


# --- diffs

_CHANGED = """, changed AS (SELECT 1 + l_partkey % 150 AS file_id, CASE WHEN l_partkey % 150 % 3 = 0 THEN 'NEW' WHEN l_partkey % 150 % 3 = 1 THEN 'OLD' WHEN l_linenumber % 2 = 0 THEN 'NEW' ELSE 'OLD' END AS side, l_quantity::INT AS line_number FROM lineitem),
whole AS (SELECT file_id, count(*) FILTER (side = 'NEW') AS a, count(*) FILTER (side = 'OLD') AS d FROM changed GROUP BY 1),
mapped AS (SELECT symbol_id, file_id, name, kind, count(*) FILTER (side = 'NEW') AS added_lines, count(*) FILTER (side = 'OLD') AS deleted_lines FROM changed JOIN symbols USING (file_id) WHERE line_number BETWEEN line_start AND line_end GROUP BY 1, 2, 3, 4)
"""


def made_changes(t) -> DataFrame:
    third = F.col("l_partkey") % 150 % 3
    side = F.when(third == 0, "NEW").when(third == 1, "OLD").when(F.col("l_linenumber") % 2 == 0, "NEW").otherwise("OLD")
    return t("lineitem").select((1 + F.col("l_partkey") % 150).alias("file_id"), side.alias("side"), F.col("l_quantity").cast("int").alias("line_number"))


@query(MADE + _CHANGED + "SELECT mapped.*, CASE WHEN a > 0 AND d = 0 THEN 'ADDED' WHEN d > 0 AND a = 0 THEN 'DELETED' ELSE 'MODIFIED' END AS change_type FROM mapped JOIN whole USING (file_id)")
def mapped_symbols(t):
    return diff.mapped_symbols(made_changes(t), made_symbols(t))


@query(MADE + _CHANGED + """, m AS (SELECT file_id, CASE WHEN a > 0 AND d = 0 THEN 'ADDED' WHEN d > 0 AND a = 0 THEN 'DELETED' ELSE 'MODIFIED' END AS change_type FROM mapped JOIN whole USING (file_id))
SELECT file_id, sum(n)::BIGINT AS n, string_agg(change_type || '=' || n, ',' ORDER BY change_type) AS histogram FROM (SELECT file_id, change_type, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1""")
def changes_by_file(t):
    got = diff.detail(diff.mapped_symbols(made_changes(t), made_symbols(t)))
    return got.withColumn("histogram", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(MADE + """, ns AS (SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'R090' END AS code, path, CASE WHEN file_id % 4 = 3 THEN path || '.old' END AS old_path FROM files)
SELECT path, old_path, CASE file_id % 4 WHEN 0 THEN 'ADDED' WHEN 1 THEN 'MODIFIED' WHEN 2 THEN 'DELETED' ELSE 'RENAMED' END AS status, CASE WHEN file_id % 7 IN (0, 6) THEN 0 ELSE file_id % 50 END::INT AS additions, CASE WHEN file_id % 7 IN (0, 6) THEN 0 ELSE file_id % 30 END::INT AS deletions, file_id % 7 = 0 AS "binary", file_id AS new_file_id, CASE WHEN old_path IS NULL THEN file_id END AS old_file_id FROM ns""")
def numstat_links(t):
    files = made_files(t)
    key = F.col("file_id")
    code = F.when(key % 4 == 0, "A").when(key % 4 == 1, "M").when(key % 4 == 2, "D").otherwise("R090")
    names = files.select(code.alias("code"), "path", F.when(key % 4 == 3, F.concat("path", F.lit(".old"))).alias("old_path"))
    number = lambda n: F.when(key % 7 == 0, "-").otherwise((key % n).cast("string"))
    counts = files.where("file_id % 7 != 6").select(F.when(key % 4 == 3, F.concat(F.lit("x => "), "path")).otherwise(F.col("path")).alias("path"), number(50).alias("additions"), number(30).alias("deletions"))
    return diff.linked(diff.numstat(names, counts).drop("file_category"), files)


@query(MADE + _CHANGED + "SELECT (SELECT count(*) FROM files) AS files_changed, (SELECT sum(size_bytes) FROM files)::BIGINT AS insertions, (SELECT sum(file_id) FROM files)::BIGINT AS deletions, (SELECT count(*) FROM mapped) AS symbols_changed")
def diff_totals(t):
    changes = made_files(t).select(F.col("size_bytes").alias("additions"), F.col("file_id").alias("deletions"))
    return diff.totals(changes, diff.mapped_symbols(made_changes(t), made_symbols(t)))


# --- impact

_ROOTS = """, mapped_ AS (SELECT symbol_id, s.file_id, s.name, path FROM symbols s JOIN files USING (file_id) WHERE symbol_id % 101 = 0 AND kind != 'IMPORT'),
rt AS (SELECT 'S' || symbol_id AS node, FALSE AS file_level FROM mapped_ UNION ALL SELECT 'F' || file_id, file_id NOT IN (SELECT file_id FROM mapped_) FROM files WHERE file_id % 13 = 0),
used AS (SELECT *, CASE WHEN source_symbol_id IS NULL OR type = 'TESTS' THEN 'F' || evidence_file_id ELSE 'S' || source_symbol_id END AS lead FROM edges WHERE status = 'RESOLVED' AND type IN ('TESTS', 'CALLS', 'REFERENCES', 'EXTENDS', 'IMPLEMENTS', 'IMPORTS')),
by_symbol AS (SELECT 'S' || target_symbol_id AS source, lead AS target, type FROM used WHERE target_symbol_id IS NOT NULL),
through AS (SELECT 'S' || m.symbol_id AS source, b.target, b.type FROM symbols m JOIN symbols h ON h.symbol_id = m.parent_symbol_id AND h.kind IN ('CLASS', 'INTERFACE') JOIN by_symbol b ON b.source = 'S' || h.symbol_id),
by_file AS (SELECT 'F' || target_file_id AS source, lead AS target, type FROM used WHERE target_symbol_id IS NULL AND target_file_id IS NOT NULL AND 'F' || target_file_id IN (SELECT node FROM rt WHERE file_level)),
adj AS (SELECT * FROM by_symbol WHERE source != target UNION ALL SELECT * FROM through WHERE source != target UNION ALL SELECT * FROM by_file WHERE source != target)
"""


def made_roots(t) -> tuple[DataFrame, DataFrame]:
    """Changed symbols, and all roots."""
    mapped = made_symbols(t).where("symbol_id % 101 = 0 AND kind != 'IMPORT'").select("symbol_id", "file_id", "name")
    changes = made_files(t).where("file_id % 13 = 0").select("path", F.col("file_id").alias("new_file_id"), F.col("file_id").alias("old_file_id"))
    return mapped, impact.roots(mapped, changes, made_files(t))


@query(MADE + _ROOTS + "SELECT node, file_level FROM rt")
def impact_roots(t):
    return made_roots(t)[1].select("node", "file_level")


@query(MADE + _ROOTS + "SELECT source, target, type AS kind, count(*) AS n FROM adj GROUP BY 1, 2, 3")
def impact_adjacency(t):
    _, roots = made_roots(t)
    return impact.adjacency(made_edges(t), made_symbols(t), made_files(t), roots).groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(MADE + _ROOTS + """, n1 AS (SELECT DISTINCT target AS node FROM adj WHERE source IN (SELECT node FROM rt) AND target NOT IN (SELECT node FROM rt)),
n2 AS (SELECT DISTINCT target AS node FROM adj WHERE source IN (SELECT node FROM n1) AND target NOT IN (SELECT node FROM rt) AND target NOT IN (SELECT node FROM n1)),
every AS (SELECT node, 0 AS depth FROM rt UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2)
SELECT node, depth, depth AS steps, CASE WHEN node LIKE 'S%' THEN 'SYMBOL' ELSE 'FILE' END AS node_type, CASE depth WHEN 0 THEN 'DIRECT' ELSE 'POTENTIAL' END AS impact_class, FALSE AS truncated FROM every""")
def impact_nodes(t):
    _, roots = made_roots(t)
    nodes = impact.traversed(roots, made_edges(t), made_symbols(t), made_files(t), 2, limit=1 << 30)
    return nodes.select("node", "depth", F.size("path").alias("steps"), "node_type", "impact_class", "truncated")


_RANKED = _ROOTS + """, pr AS (SELECT *, CASE type WHEN 'TESTS' THEN 0 WHEN 'CALLS' THEN 1 WHEN 'REFERENCES' THEN 2 WHEN 'EXTENDS' THEN 3 WHEN 'IMPLEMENTS' THEN 4 ELSE 5 END AS priority, coalesce(evidence_file_id, 0) AS at_file, start_line AS at_line,
  concat_ws(':', path, start_line::VARCHAR) AS spot FROM used LEFT JOIN (SELECT file_id AS evidence_file_id, path FROM files) USING (evidence_file_id)),
bs AS (SELECT 'S' || target_symbol_id AS source, lead AS target, type AS kind, priority, at_file, at_line, spot FROM pr WHERE target_symbol_id IS NOT NULL),
way AS (SELECT * FROM (SELECT *, 0 AS through FROM bs
  UNION ALL SELECT 'S' || m.symbol_id, b.target, b.kind, b.priority, b.at_file, b.at_line, b.spot, 1 FROM symbols m JOIN symbols h ON h.symbol_id = m.parent_symbol_id AND h.kind IN ('CLASS', 'INTERFACE') JOIN bs b ON b.source = 'S' || h.symbol_id
  UNION ALL SELECT 'F' || target_file_id, lead, type, priority, at_file, at_line, spot, 0 FROM pr WHERE target_symbol_id IS NULL AND target_file_id IS NOT NULL AND 'F' || target_file_id IN (SELECT node FROM rt WHERE file_level)) WHERE source != target),
l0 AS (SELECT node, 0 AS depth, node AS root, NULL AS via, NULL AS via_source, '' AS path, row_number() OVER (ORDER BY k, path, name, id) AS rank FROM (SELECT 'S' || symbol_id AS node, 0 AS k, path, name, symbol_id AS id FROM mapped_ UNION ALL SELECT 'F' || file_id, 1, path, '', 0 FROM files WHERE file_id % 13 = 0)),
l1 AS (SELECT node, 1 AS depth, root, via, via_source, path, (SELECT count(*) FROM l0) + row_number() OVER (ORDER BY parent, through, priority, at_file, at_line, via, node) AS rank FROM (SELECT target AS node, root, kind AS via, source AS via_source, source || ' ' || kind || ' ' || target || ' ' || spot AS path, rank AS parent, through, priority, at_file, at_line,
  row_number() OVER (PARTITION BY target ORDER BY rank, through, priority, at_file, at_line, kind) AS n FROM l0 JOIN way ON source = node WHERE target NOT IN (SELECT node FROM l0)) WHERE n = 1),
l2 AS (SELECT node, 2 AS depth, root, via, via_source, path, (SELECT count(*) FROM l0) + (SELECT count(*) FROM l1) + row_number() OVER (ORDER BY parent, through, priority, at_file, at_line, via, node) AS rank FROM (SELECT target AS node, root, kind AS via, source AS via_source, path || '; ' || source || ' ' || kind || ' ' || target || ' ' || spot AS path, rank AS parent, through, priority, at_file, at_line,
  row_number() OVER (PARTITION BY target ORDER BY rank, through, priority, at_file, at_line, kind) AS n FROM l1 JOIN way ON source = node WHERE target NOT IN (SELECT node FROM l0) AND target NOT IN (SELECT node FROM l1)) WHERE n = 1)
"""


def _found(t, depth: int, limit: int) -> DataFrame:
    """What a traversal finds, with the way to it as text."""
    nodes = impact.traversed(made_roots(t)[1], made_edges(t), made_symbols(t), made_files(t), depth, limit=limit)
    steps = F.array_join(F.transform("path", lambda p: F.concat_ws(" ", p["source"], p["kind"], p["target"], p["at"])), "; ")
    return nodes.select("node", "depth", "rank", "root", "via", "via_source", steps.alias("path"), "truncated")


@query(MADE + _RANKED + "SELECT node, depth, rank, root, via, via_source, path, (SELECT count(*) FROM l1) > 7 AS truncated FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) WHERE rank <= (SELECT count(*) FROM l0) + 7")
def impact_cap(t):
    """The limit is reached within the first level: the second isn't expanded."""
    return _found(t, 2, made_roots(t)[1].count() + 7)


@query(MADE + _RANKED + "SELECT node, depth, rank, root, via, via_source, path, (SELECT count(*) FROM l2) > 9 AS truncated FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE rank <= (SELECT count(*) FROM l0) + (SELECT count(*) FROM l1) + 9")
def impact_cap_second(t):
    """The limit is reached within the second level."""
    return _found(t, 2, _found(t, 1, 1 << 30).count() + 9)


@query(MADE + _RANKED + """, own AS (SELECT DISTINCT coalesce('S' || source_symbol_id, 'F' || evidence_file_id) AS owner, evidence_file_id, type, start_line FROM edges WHERE status = 'UNRESOLVED'), u AS (SELECT count(*) AS n FROM own WHERE owner IN (SELECT node FROM rt)),
ex AS (SELECT count(*) AS n FROM (SELECT DISTINCT evidence_file_id, target_file_id FROM edges WHERE status = 'EXTERNAL' AND coalesce('S' || source_symbol_id, 'F' || evidence_file_id) IN (SELECT node FROM rt))),
pot AS (SELECT l1.node, l1.via, f.path FROM l1 LEFT JOIN files f ON l1.node = 'F' || f.file_id),
test AS (SELECT count(*) AS n FROM pot WHERE node LIKE 'F%' AND (via = 'TESTS' OR path LIKE '%/test\\_%' ESCAPE '\\'))
SELECT (SELECT count(*) FROM rt WHERE node LIKE 'S%') AS changed_symbols, (SELECT count(*) FROM rt WHERE node LIKE 'F%') AS changed_files, (SELECT count(*) FROM rt) AS total_direct, (SELECT count(*) FROM l1) - (SELECT n FROM test) AS potential, (SELECT n FROM test) AS affected_tests, (SELECT max(depth) FROM (SELECT 0 AS depth UNION ALL SELECT depth FROM l1)) AS deepest,
CASE WHEN u.n > 5 THEN 'unresolved node limit reached' WHEN ex.n > 5 THEN 'external node limit reached' WHEN (SELECT count(*) FROM l1) > 3 THEN 'impact path limit reached' END AS truncated_reason, least(u.n, 5) AS unresolved, least(ex.n, 5) AS external FROM u, ex""")
def impact_summary(t):
    """All counters, and the first limit that was reached."""
    roots, edges = made_roots(t)[1], made_edges(t)
    nodes = impact.traversed(roots, edges, made_symbols(t), made_files(t), 1, limit=1 << 30)
    ends = [impact.open_ends(roots, edges, status, limit=5) for status in ("UNRESOLVED", "EXTERNAL")]
    return impact.summary(nodes, *ends, most_paths=3).drop("truncated")


@query(MADE + _ROOTS + """, own AS (SELECT *, coalesce('S' || source_symbol_id, 'F' || evidence_file_id) AS owner FROM edges WHERE status = 'UNRESOLVED'),
k AS (SELECT DISTINCT owner, evidence_file_id, type, start_line FROM own WHERE owner IN (SELECT node FROM rt))
SELECT * FROM k""")
def unresolved_ends(t):
    _, roots = made_roots(t)
    return impact.open_ends(roots, made_edges(t), "UNRESOLVED", limit=1 << 30).select("owner", "evidence_file_id", "type", "start_line")


@query(MADE + _ROOTS + """, own AS (SELECT *, coalesce('S' || source_symbol_id, 'F' || evidence_file_id) AS owner FROM edges WHERE status = 'EXTERNAL')
SELECT evidence_file_id, min(start_line) AS start_line FROM own WHERE owner IN (SELECT node FROM rt) GROUP BY evidence_file_id, target_file_id""")
def external_ends(t):
    _, roots = made_roots(t)
    return impact.open_ends(roots, made_edges(t), "EXTERNAL", limit=1 << 30).select("evidence_file_id", "start_line")


# --- lists and neighbourhoods

_TOUCH = ", touch AS (SELECT * FROM edges WHERE source_symbol_id = 8 OR target_symbol_id = 8)"


@query(MADE + _TOUCH + """SELECT CASE WHEN status = 'EXTERNAL' THEN 'external' WHEN status = 'UNRESOLVED' THEN 'unresolved' WHEN type IN ('DEFINES', 'EXTENDS', 'IMPLEMENTS') THEN 'dependencies' WHEN type = 'CALLS' THEN CASE WHEN source_symbol_id = 8 THEN 'callees' ELSE 'callers' END ELSE lower(type) END AS "group",
a.qualified_name AS source_name, b.qualified_name AS target_name, path AS evidence_path, start_line FROM touch t LEFT JOIN files ON file_id = evidence_file_id LEFT JOIN symbols a ON a.symbol_id = source_symbol_id LEFT JOIN symbols b ON b.symbol_id = target_symbol_id""")
def neighbourhood_groups(t):
    return search.investigate(made_edges(t), made_symbols(t), made_files(t), 8).select("group", "source_name", "target_name", "evidence_path", "start_line")


@query(MADE + _TOUCH + """, p AS (SELECT path FROM touch JOIN files ON file_id = evidence_file_id UNION SELECT path FROM touch JOIN files ON file_id = target_file_id UNION SELECT 'src/own.py') SELECT path FROM p ORDER BY path LIMIT 100""")
def related_files(t):
    return search.related_files(search.investigate(made_edges(t), made_symbols(t), made_files(t), 8), made_files(t), own="src/own.py")


@query(MADE + _TOUCH + """SELECT type, source_symbol_id, target_symbol_id, start_line, (SELECT count(*) FROM touch) AS total FROM touch ORDER BY coalesce(source_symbol_id != 8, TRUE), type, evidence_file_id, start_line, source_symbol_id NULLS FIRST, target_symbol_id NULLS FIRST, status LIMIT 6 OFFSET 2""")
def symbol_neighbours(t):
    return listing.neighbours(made_edges(t), 8, 6, 2).select("type", "source_symbol_id", "target_symbol_id", "start_line", "total")


@query(MADE + """, h AS (SELECT s.*, path FROM symbols s JOIN files f USING (file_id) WHERE repository_id = 2 AND name ILIKE '%f1%' AND kind ILIKE 'function' AND language ILIKE 'python')
SELECT symbol_id, name, path, (SELECT count(*) FROM h) AS total FROM h ORDER BY path, line_start, symbol_id LIMIT 20 OFFSET 3""")
def symbol_list(t):
    return listing.symbols(made_symbols(t), made_files(t), 2, name="F1", kind="function", language="PYTHON", limit=20, offset=3).select("symbol_id", "name", "path", "total")


@query(MADE + """, h AS (SELECT e.*, path FROM edges e JOIN files ON file_id = evidence_file_id AND repository_id = 2 WHERE type = 'CALLS' AND status = 'RESOLVED' AND source_symbol_id IN (SELECT symbol_id FROM symbols WHERE name = 'f8'))
SELECT source_symbol_id, target_symbol_id, path AS evidence_path, start_line, (SELECT count(*) FROM h) AS total FROM h ORDER BY path, start_line, source_symbol_id, target_symbol_id NULLS FIRST LIMIT 15""")
def relationship_list(t):
    return listing.relationships(made_edges(t), made_symbols(t), made_files(t), 2, type="calls", status="RESOLVED", source="f8", limit=15).select("source_symbol_id", "target_symbol_id", "evidence_path", "start_line", "total")


@query(MADE + _IMPORTS + """, h AS (SELECT import_id, path FROM imports JOIN files USING (file_id) WHERE repository_id = 1 AND source ILIKE '%M1%') SELECT import_id, path, (SELECT count(*) FROM h) AS total FROM h ORDER BY path, import_id LIMIT 12""")
def import_list(t):
    return listing.imports(made_imports(t), made_files(t), 1, source="M1", limit=12).select("import_id", "path", "total")


@query(MADE + "SELECT file_id, path, coalesce(a, 0) AS symbol_count, coalesce(b, 0) AS relationship_count FROM files LEFT JOIN (SELECT file_id, count(*) AS a FROM symbols GROUP BY 1) USING (file_id) LEFT JOIN (SELECT evidence_file_id AS file_id, count(*) AS b FROM edges GROUP BY 1) USING (file_id)")
def file_counts(t):
    return listing.file_counts(made_files(t), made_symbols(t), made_edges(t))


@query("SELECT 'order' AS kind, o_orderkey AS id FROM (SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 3) UNION ALL SELECT 'part', p_partkey FROM (SELECT p_partkey FROM part ORDER BY 1 DESC LIMIT 3)")
def recent_rows(t):
    return listing.recent({"order": (t("orders"), "o_orderkey"), "part": (t("part"), "p_partkey")})


@query(MADE + "SELECT repository_id, language, sum(size_bytes)::BIGINT AS bytes, round(100.0 * sum(size_bytes) / sum(sum(size_bytes)) OVER (PARTITION BY repository_id), 1) AS share FROM files GROUP BY 1, 2")
def repository_languages(t):
    return sources.language_shares(made_files(t), ["repository_id"])


@query("SELECT 'parsed' AS status, count(*) AS files, sum(o_custkey % 4)::BIGINT AS symbols, sum(o_custkey % 3)::BIGINT AS imports, count(*) AS exports FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'failed', count(*), sum(o_custkey % 4), sum(o_custkey % 3), count(*) FROM orders WHERE o_orderkey % 3 = 0")
def parse_totals(t):
    rows = lambda n: F.array_repeat(F.lit(1), (F.col("o_custkey") % n).cast("int"))
    return extract.status_counts(t("orders").select(F.when(F.col("o_orderkey") % 3 > 0, "parsed").otherwise("failed").alias("status"), rows(4).alias("symbols"), rows(3).alias("imports"), F.array(F.lit(1)).alias("exports")))


@query(MADE + "SELECT (SELECT count(*) FROM files WHERE repository_id != 2) AS files, (SELECT count(*) FROM symbols WHERE file_id NOT IN (SELECT file_id FROM files WHERE repository_id = 2)) AS symbols, (SELECT count(*) FROM part) AS others")
def cascade_delete(t):
    left = sources.without_repository({"files": made_files(t), "symbols": made_symbols(t), "others": t("part").select(F.col("p_partkey").alias("other_id"))}, 2)
    n = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in left.items()]
    return n[0].crossJoin(n[1]).crossJoin(n[2])  # one row each


# --- checklists and contexts

_NODES = """
WITH nodes AS (SELECT 'S' || o_orderkey AS node, CASE WHEN o_orderkey % 3 = 0 THEN 'FILE' ELSE 'SYMBOL' END AS node_type, 'n' || o_orderkey AS name, 'p' || o_custkey AS file_path, ['CONFIG', 'DOCUMENTATION', 'SOURCE'][o_custkey % 3 + 1] AS category,
  ['DIRECT', 'POTENTIAL', 'POTENTIAL', 'UNRESOLVED', 'EXTERNAL'][o_orderkey % 5 + 1] AS impact_class, (o_orderkey % 5 + o_custkey % 2)::INT AS depth, ['CALLS', 'IMPORTS', 'REFERENCES'][o_custkey % 3 + 1] AS via, o_orderkey % 5 = 2 AND o_custkey % 2 = 0 AS is_test, TRUE AS file_level FROM orders)
"""


def made_nodes(t) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, key: F.get(F.array(*[F.lit(x) for x in names]), key % len(names))
    return t("orders").select(
        F.concat(F.lit("S"), order.cast("string")).alias("node"), F.when(order % 3 == 0, "FILE").otherwise("SYMBOL").alias("node_type"), F.concat(F.lit("n"), order.cast("string")).alias("name"), F.concat(F.lit("p"), customer.cast("string")).alias("file_path"),
        pick(("CONFIG", "DOCUMENTATION", "SOURCE"), customer).alias("category"), pick(("DIRECT", "POTENTIAL", "POTENTIAL", "UNRESOLVED", "EXTERNAL"), order).alias("impact_class"), (order % 5 + customer % 2).cast("int").alias("depth"),
        pick(("CALLS", "IMPORTS", "REFERENCES"), customer).alias("via"), ((order % 5 == 2) & (customer % 2 == 0)).alias("is_test"), F.lit(True).alias("file_level"),
    )


_ITEMS = _NODES + """, typed AS (SELECT *, CASE WHEN impact_class = 'DIRECT' AND node_type = 'SYMBOL' THEN 'CHANGED_CODE' WHEN impact_class = 'DIRECT' AND category = 'CONFIG' THEN 'CONFIGURATION_CHANGE' WHEN impact_class = 'DIRECT' AND category = 'DOCUMENTATION' THEN 'DOCUMENTATION_CHANGE' WHEN impact_class = 'DIRECT' THEN 'CHANGED_CODE'
  WHEN impact_class = 'POTENTIAL' AND is_test THEN 'AFFECTED_TEST' WHEN impact_class = 'POTENTIAL' AND via IN ('CALLS', 'REFERENCES') THEN 'AFFECTED_CALLER' WHEN impact_class = 'POTENTIAL' THEN 'AFFECTED_DEPENDENCY' WHEN impact_class = 'UNRESOLVED' THEN 'UNRESOLVED_IMPACT' ELSE 'EXTERNAL_DEPENDENCY' END AS item_type FROM nodes),
grouped AS (SELECT item_type, CASE WHEN item_type = 'CHANGED_CODE' AND node_type = 'SYMBOL' THEN node WHEN item_type = 'AFFECTED_CALLER' THEN via || '/' || CASE WHEN depth <= 1 THEN 'direct' ELSE 'transitive' END WHEN item_type = 'AFFECTED_DEPENDENCY' THEN via ELSE 'all' END AS g, count(*) AS total, min(via) AS via, min(depth <= 1) AS near, min(file_path) AS first_path, min(name) AS first_name FROM typed GROUP BY 1, 2),
ranked AS (SELECT *, CASE WHEN item_type IN ('CHANGED_CODE', 'AFFECTED_TEST', 'CONFIGURATION_CHANGE') THEN 'REQUIRED' WHEN item_type = 'AFFECTED_CALLER' THEN CASE WHEN near THEN 'REQUIRED' ELSE 'RECOMMENDED' END WHEN item_type = 'DOCUMENTATION_CHANGE' THEN 'INFORMATIONAL' ELSE 'RECOMMENDED' END AS priority,
  row_number() OVER (PARTITION BY item_type ORDER BY first_path, first_name, g) - 1 AS place FROM grouped),
items AS (SELECT item_type || ':' || g AS stable_key, *, (CASE priority WHEN 'REQUIRED' THEN 0 WHEN 'RECOMMENDED' THEN 1000 ELSE 2000 END + CASE item_type WHEN 'CHANGED_CODE' THEN 0 WHEN 'AFFECTED_CALLER' THEN 100 WHEN 'AFFECTED_DEPENDENCY' THEN 200 WHEN 'AFFECTED_TEST' THEN 300 WHEN 'CONFIGURATION_CHANGE' THEN 400 WHEN 'UNRESOLVED_IMPACT' THEN 500 WHEN 'EXTERNAL_DEPENDENCY' THEN 600 ELSE 700 END + place)::INT AS sort
  FROM ranked ORDER BY sort, stable_key LIMIT 300)
"""


@query(_ITEMS + "SELECT stable_key, item_type, total, priority, sort, least(total, 200)::INT AS listed, CASE WHEN total > 200 THEN format('Showing the first 200 of {} entries.', total) ELSE '' END AS note FROM items")
def review_items(t):
    return review.items(made_nodes(t)).select("stable_key", "item_type", "total", "priority", "sort", F.size("entries").alias("listed"), "note")


@query(_ITEMS + """, old AS (SELECT * FROM items WHERE total % 2 = 1)
SELECT stable_key, CASE WHEN old.stable_key IS NULL THEN 'OPEN' ELSE 'DONE' END AS status, coalesce('n' || old.total, '') AS notes FROM items LEFT JOIN old USING (stable_key)""")
def review_carryover(t):
    new = review.items(made_nodes(t))
    old = new.where("total % 2 = 1").select("stable_key", F.lit("DONE").alias("status"), F.concat(F.lit("n"), F.col("total").cast("string")).alias("notes"), "entries")
    return review.carried(new, old).select("stable_key", "status", "notes")


@query("""WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS v FROM events GROUP BY 1)
SELECT c_custkey, coalesce(status, 'OPEN') AS status, coalesce(floor(v)::BIGINT::VARCHAR, '') AS notes FROM customer LEFT JOIN last ON user_id = c_custkey""")
def review_updates(t):
    log = t("events").select(F.col("user_id").alias("stable_key"), F.col("event_type").alias("status"), F.floor("value").cast("long").cast("string").alias("notes"), F.col("event_id").alias("updated_at"))
    items = t("customer").select(F.col("c_custkey").alias("stable_key"), F.lit("OPEN").alias("status"), F.lit("").alias("notes"))
    return review.updated(items, log).withColumnRenamed("stable_key", "c_custkey")


@query("""SELECT count(*) AS items, count(*) FILTER (p_size % 3 = 0) AS required, count(*) FILTER (p_size % 3 = 1) AS recommended, count(*) FILTER (p_size % 3 = 2) AS informational, count(*) FILTER (p_partkey % 4 = 0) AS open, count(*) FILTER (p_partkey % 4 = 1) AS done, count(*) FILTER (p_partkey % 4 = 2) AS skipped FROM part""")
def status_totals(t):
    pick = lambda names, key: F.get(F.array(*[F.lit(x) for x in names]), F.col(key) % len(names))
    return review.counters(t("part").select(pick(("REQUIRED", "RECOMMENDED", "INFORMATIONAL"), "p_size").alias("priority"), pick(("OPEN", "DONE", "SKIPPED_", "x"), "p_partkey").alias("s")).select("priority", F.when(F.col("s") == "SKIPPED_", "SKIPPED").otherwise(F.col("s")).alias("status")))


@query("""WITH c AS (SELECT s_suppkey AS key, unnest(range(0, 9)) AS pos FROM supplier), i AS (SELECT key, pos, (key * 3 + pos * 5) % 40 AS "index" FROM c), e AS (SELECT n_nationkey AS "index", n_name AS text FROM nation),
j AS (SELECT i.*, text, row_number() OVER (PARTITION BY key ORDER BY pos) AS rank FROM i JOIN e USING ("index")) SELECT key, "index", text, rank FROM j WHERE rank <= 6""")
def evidence_selection(t):
    chosen = t("supplier").select(F.col("s_suppkey").alias("key"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda at: (F.col("s_suppkey") * 3 + at * 5) % 40).alias("indices"))
    evidence = t("nation").select(F.col("n_nationkey").cast("long").alias("index"), F.col("n_name").alias("text"))
    return context.selected(evidence, chosen).select("key", "index", "text", "rank")


@query("""WITH e AS (SELECT p_brand AS kind, lpad(p_partkey::VARCHAR, 8, '0') AS place, p_name AS text FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY place) AS n FROM e), f AS (SELECT * FROM k WHERE n <= 30 ORDER BY place LIMIT 100),
r AS (SELECT kind, place, text, sum(length(text)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS running_cost FROM f) SELECT * FROM r WHERE running_cost <= 1200""")
def context_budget(t):
    evidence = t("part").select(F.col("p_brand").alias("kind"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("place"), F.col("p_name").alias("text"))
    return review.context(evidence, 1200).drop("digest")


@query(_NODES + """, k AS (SELECT *, row_number() OVER (PARTITION BY impact_class ORDER BY depth, name, node) AS rank FROM nodes) SELECT lower(impact_class) AS kind, name, name || ' ' || via || ' depth ' || depth AS text FROM k WHERE rank <= 30
UNION ALL SELECT 'external', e, e FROM (SELECT DISTINCT n_name AS e FROM nation ORDER BY 1 LIMIT 10)""")
def impact_context(t):
    external = t("nation").select(F.col("n_name").alias("evidence"))
    none = made_nodes(t).limit(0).select(F.col("node").alias("root"), F.col("node").alias("target"), "depth", F.expr("cast(array() AS array<struct<source: string, kind: string, target: string>>)").alias("path"))
    return context.of_impact(made_nodes(t), external, none).select("kind", "name", "text")


@query("SELECT l_orderkey AS path, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN '+ ' ELSE '- ' END || l_linenumber || ': ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_linenumber % 2, l_returnflag) AS text FROM lineitem GROUP BY 1")
def changed_texts(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("path"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "NEW").otherwise("OLD").alias("side"), F.col("l_returnflag").alias("text")).withColumnRenamed("l_linenumber", "line_number")
    return context.changed_text(rows, ["path"])


@query(_NODES + """, known AS (SELECT impact_class, node_type, name, min(node) AS node FROM nodes GROUP BY 1, 2, 3) SELECT c_custkey, node FROM customer LEFT JOIN known ON name = 'n' || c_custkey AND impact_class = 'POTENTIAL' AND node_type = 'SYMBOL'""")
def evidence_identity(t):
    evidence = t("customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"), F.lit("POTENTIAL").alias("impact_class"), F.lit("SYMBOL").alias("node_type"))
    return context.identified(evidence, made_nodes(t)).select("c_custkey", "node")


# --- views

_PATHS_SQL = "SELECT o_orderkey, 'r' || o_custkey % 7 AS root, 'n' || o_custkey % 50 AS target, (o_orderkey % 4)::INT AS depth FROM orders"


@query(f"SELECT target AS target_name, depth, root FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY depth, root) AS n FROM ({_PATHS_SQL})) WHERE n = 1")
def shortest_paths(t):
    key = F.col("o_custkey")
    rows = t("orders").select(F.concat(F.lit("r"), (key % 7).cast("string")).alias("root"), F.concat(F.lit("n"), (key % 50).cast("string")).alias("target"), (F.col("o_orderkey") % 4).cast("int").alias("depth"))
    return review.shortest_paths(rows.withColumn("target_name", F.col("target"))).select("target_name", "depth", "root")


@query(_NODES + """, g AS (SELECT 'x' || substr(name, 2)::INT % 40 AS name, node, depth FROM nodes WHERE depth <= 3 AND node_type != 'FILE'), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth, node) AS n FROM g) WHERE n = 1)
SELECT name, node, greatest(depth, 1) AS layer, (row_number() OVER (PARTITION BY greatest(depth, 1) ORDER BY name) - 1)::INT AS "column" FROM o""")
def graph_layout(t):
    nodes = made_nodes(t).withColumn("name", F.concat(F.lit("x"), (F.substring("name", 2, 9).cast("int") % 40).cast("string")))
    return views.graph_nodes(nodes, 3, with_files=False).select("name", "node", "layer", "column")


@query("""WITH st AS (SELECT DISTINCT 'P' || l_partkey AS source, l_returnflag AS kind, 'S' || l_suppkey AS target FROM lineitem) SELECT * FROM st WHERE substr(source, 2)::INT % 3 = 0 AND substr(target, 2)::INT % 2 = 0""")
def graph_edges(t):
    step = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"))
    shown = t("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node")).union(t("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))))
    return views.graph_edges(t("lineitem").select(F.array(step).alias("path")), shown)


@query("SELECT p_partkey, p_name AS label FROM part WHERE contains(lower(p_name), 'al')")
def palette_entries(t):
    return views.palette(t("part").select("p_partkey", F.col("p_name").alias("label")), " AL ")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'REQUIRED' WHEN 1 THEN 'RECOMMENDED' ELSE 'INFORMATIONAL' END AS priority FROM part WHERE p_partkey % 2 = 0""")
def open_items(t):
    priority = F.when(F.col("p_size") % 3 == 0, "REQUIRED").when(F.col("p_size") % 3 == 1, "RECOMMENDED").otherwise("INFORMATIONAL")
    items = t("part").select("p_partkey", priority.alias("priority"), F.when(F.col("p_partkey") % 2 == 0, "OPEN").otherwise("DONE").alias("status"), F.lit("CHANGED_CODE").alias("item_type"), F.col("p_size").alias("sort"), F.col("p_partkey").alias("stable_key"))
    return views.filtered_items(items, "open").select("p_partkey", "priority")


@query(f"SELECT o_orderkey FROM ({_PATHS_SQL}) WHERE root = 'r3' OR target = 'r3'")
def paths_through_node(t):
    key = F.col("o_custkey")
    none = F.expr("cast(array() AS array<struct<source: string, kind: string, target: string>>)")
    rows = t("orders").select("o_orderkey", F.concat(F.lit("r"), (key % 7).cast("string")).alias("root"), F.concat(F.lit("n"), (key % 50).cast("string")).alias("target"), none.alias("path"))
    return views.paths_through(rows, "r3").select("o_orderkey")
