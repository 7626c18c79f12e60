"""Queries of the call, reference and test resolvers and of the contexts over made code, each with its DuckDB SQL.

Every part is a file of twelve lines with a class, its method and two functions, which import from and call another file's. The SQL has
the call sites and names of these lines as rows; whom they belong to and what they mean is computed by joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.lineage import measured_broadcasts, saved
from .plan_queries import _ITEMS, _ROOTS, MADE, made_edges, made_nodes, made_roots
from .plans import context, impact, resolve, review, search, views
from .queries import query

_CODE = """
WITH files AS (SELECT p_partkey AS file_id, CASE WHEN p_partkey % 9 = 0 THEN 'tests/test_m' ELSE 'pkg/m' END || p_partkey || '.py' AS path, 1 + p_partkey * 7 % 250 AS p FROM part),
symbols AS (SELECT 4 * file_id AS symbol_id, file_id, 'K' || file_id AS name, 'CLASS' AS kind, 3 AS line_start, 5 AS line_end, NULL AS parent FROM files UNION ALL SELECT 4 * file_id + 1, file_id, 'run', 'METHOD', 4, 5, 4 * file_id FROM files
  UNION ALL SELECT 4 * file_id + 2, file_id, 'f' || file_id, 'FUNCTION', 7, 9, NULL FROM files UNION ALL SELECT 4 * file_id + 3, file_id, 'h' || file_id, 'FUNCTION', 11, 12, NULL FROM files),
bound AS (SELECT f.file_id, s.name, s.symbol_id AS bound, s.kind FROM files f JOIN symbols s ON s.file_id = f.p AND s.name IN ('K' || f.p, 'f' || f.p)),
here AS (SELECT file_id, name, min(symbol_id) AS local FROM symbols GROUP BY 1, 2)
"""
_SITES = _CODE + """, sites AS (SELECT file_id, 5 AS line, 'f' || p AS name, NULL AS receiver FROM files UNION ALL SELECT file_id, 5, 'go', NULL FROM files UNION ALL SELECT file_id, 8, 'run', 'K' || p FROM files UNION ALL SELECT file_id, 8, 'K' || p, NULL FROM files UNION ALL SELECT file_id, 9, 'h' || file_id, NULL FROM files),
around AS (SELECT x.*, s.symbol_id AS caller FROM sites x JOIN symbols s ON s.file_id = x.file_id AND x.line BETWEEN s.line_start AND s.line_end),
owner AS (SELECT a.*, coalesce(b.bound, h.local) AS meant FROM around a LEFT JOIN bound b ON b.file_id = a.file_id AND b.name = coalesce(a.receiver, a.name) LEFT JOIN here h ON h.file_id = a.file_id AND h.name = coalesce(a.receiver, a.name)),
member AS (SELECT o.*, m.symbol_id AS member FROM owner o LEFT JOIN symbols c ON c.symbol_id = o.meant AND c.kind = 'CLASS' LEFT JOIN symbols m ON m.parent = c.symbol_id AND m.name = o.name)
"""
_USES = _CODE + """, uses AS (SELECT file_id, 5 AS line, 1 AS place, 'f' || p AS name FROM files UNION ALL SELECT file_id, 8, 2, 'K' || p FROM files UNION ALL SELECT file_id, 8, 3, 'run' FROM files UNION ALL SELECT file_id, 9, 1, 'h' || file_id FROM files)"""


def made_code(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files with content, symbols, and import bindings."""
    key, p = F.col("p_partkey"), 1 + F.col("p_partkey") * 7 % 250
    measured_broadcasts(t("part").sparkSession)
    i, q = key.cast("string"), p.cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("from pkg.m"), q, F.lit(" import f"), q, F.lit(", K"), q), F.lit(""), F.concat(F.lit("class K"), i, F.lit(":")), F.lit("    def run(self, x):"), F.concat(F.lit("        return f"), q, F.lit("(x) + self.go(x)")), F.lit(""),
                       F.concat(F.lit("def f"), i, F.lit("(x):")), F.concat(F.lit("    value = K"), q, F.lit(".run(K"), q, F.lit("())")), F.concat(F.lit("    return h"), i, F.lit("(value)  # done")), F.lit("# K1(x) is no call"), F.concat(F.lit("def h"), i, F.lit("(x):")), F.lit("    return x"))
    path = F.concat(F.when(key % 9 == 0, "tests/test_m").otherwise("pkg/m"), i, F.lit(".py"))
    files = t("part").select(key.alias("file_id"), path.alias("path"), F.lit("Python").alias("language"), text.alias("content"), p.alias("p"))
    one = lambda n, name, kind, start, end: F.struct((F.col("file_id") * 4 + n).alias("symbol_id"), name.alias("name"), F.lit(kind).alias("kind"), F.lit(start).alias("line_start"), F.lit(end).alias("line_end"), (F.col("file_id") * 4 if n == 1 else F.lit(None).cast("long")).alias("parent_symbol_id"))
    named = lambda letter: F.concat(F.lit(letter), F.col("file_id").cast("string"))
    symbols = files.select("file_id", F.explode(F.array(one(0, named("K"), "CLASS", 3, 5), one(1, F.lit("run"), "METHOD", 4, 5), one(2, named("f"), "FUNCTION", 7, 9), one(3, named("h"), "FUNCTION", 11, 12))).alias("s")).select("file_id", "s.*")
    theirs = symbols.where("name != 'run' AND name NOT LIKE 'h%'").select(F.col("file_id").alias("p"), "name", F.col("symbol_id").alias("bound_symbol_id"), F.col("kind").alias("bound_kind"))
    return files.drop("p"), saved(symbols), saved(files.select("file_id", "p").join(theirs, "p").drop("p"))


@query(_SITES + """SELECT caller AS source_symbol_id, CASE WHEN receiver IS NULL THEN meant ELSE member END AS target_symbol_id, CASE WHEN receiver IS NULL AND meant IS NOT NULL OR receiver IS NOT NULL AND member IS NOT NULL THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, file_id AS evidence_file_id, line AS start_line, concat_ws('.', receiver, name) AS evidence FROM member""")
def call_edges(t):
    """Call sites belong to every symbol around them; targets by binding, by file, and through the receiver's class."""
    return resolve.calls(*made_code(t)).select("source_symbol_id", "target_symbol_id", "status", "evidence_file_id", "start_line", "evidence")


@query(_USES + """, owned AS (SELECT * FROM (SELECT u.*, s.symbol_id AS owner, s.line_start, row_number() OVER (PARTITION BY u.file_id, u.line, u.place ORDER BY s.line_start DESC, s.line_end, s.symbol_id) AS n FROM uses u JOIN symbols s ON s.file_id = u.file_id AND u.line BETWEEN s.line_start AND s.line_end) WHERE n = 1 AND line != line_start),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner, name ORDER BY line, place) AS k FROM owned) WHERE k = 1),
near AS (SELECT owner, f.name, arg_min(s.symbol_id, (CASE WHEN f.line BETWEEN s.line_start AND s.line_end THEN 0 ELSE 1 END) * 1000000000 + s.symbol_id) AS local FROM first f JOIN symbols s ON s.file_id = f.file_id AND s.name = f.name AND s.symbol_id != owner GROUP BY 1, 2),
r AS (SELECT f.*, coalesce(b.bound, near.local) AS target FROM first f LEFT JOIN bound b ON b.file_id = f.file_id AND b.name = f.name LEFT JOIN near ON near.owner = f.owner AND near.name = f.name)
SELECT owner AS source_symbol_id, target AS target_symbol_id, file_id AS evidence_file_id, line AS start_line, name AS evidence FROM r WHERE target != owner""")
def reference_edges(t):
    """The first use of each name in each innermost symbol."""
    return resolve.references(*made_code(t)).select("source_symbol_id", "target_symbol_id", "evidence_file_id", "start_line", "evidence")


@query(_USES + """, used AS (SELECT u.file_id, b.bound, u.line, u.name, row_number() OVER (PARTITION BY u.file_id, b.bound ORDER BY u.line, u.place) AS k FROM uses u JOIN files f USING (file_id) JOIN bound b ON b.file_id = u.file_id AND b.name = u.name WHERE path LIKE 'tests/%')
SELECT bound AS target_symbol_id, file_id AS evidence_file_id, line AS start_line, name AS evidence FROM used WHERE k = 1""")
def test_edges(t):
    """What test files use, at first use."""
    files, _, bound = made_code(t)
    return resolve.tests(files, bound).select("target_symbol_id", "evidence_file_id", "start_line", "evidence")


# --- contexts

@query("""WITH f AS (SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'ADDED' ELSE 'MODIFIED' END AS status, p_size AS a, p_partkey % 5 AS d FROM part), l AS (SELECT 'p' || l_partkey AS path, CASE WHEN l_linenumber % 2 = 0 THEN 'NEW' ELSE 'OLD' END AS side, l_linenumber AS n, l_returnflag AS text FROM lineitem),
s AS (SELECT 'p' || 1 + o_custkey % 150 AS path, 'f' || o_orderkey AS name, CASE o_orderkey % 3 WHEN 0 THEN 'ADDED' ELSE 'DELETED' END AS change_type FROM orders)
SELECT 'file' AS kind, path AS name, concat_ws(' ', path, status, '+' || a, '-' || d) AS text, '00/' || lpad(path, 24, ' ') AS place FROM f
UNION ALL SELECT 'hunk', path, string_agg(CASE side WHEN 'NEW' THEN '+ ' ELSE '- ' END || n || ': ' || text, chr(10) ORDER BY n, side, text), '01/' || lpad(path, 24, ' ') FROM l GROUP BY path
UNION ALL SELECT 'symbol', name, name || ' ' || change_type, '02/' || lpad(path, 24, ' ') || '/' || lpad(name, 24, ' ') FROM s""".replace("'p' || 1 + o_custkey % 150", "'p' || (1 + o_custkey % 150)"))
def change_context(t):
    key = F.col("p_partkey")
    path = lambda c: F.concat(F.lit("p"), c.cast("string")).alias("path")
    files = t("part").select(path(key), F.when(key % 2 == 0, "ADDED").otherwise("MODIFIED").alias("status"), F.col("p_size").cast("string").alias("additions"), (key % 5).cast("string").alias("deletions"))
    lines = t("lineitem").select(path(F.col("l_partkey")), F.when(F.col("l_linenumber") % 2 == 0, "NEW").otherwise("OLD").alias("side"), F.col("l_linenumber").alias("line_number"), F.col("l_returnflag").alias("text"))
    symbols = t("orders").select(path(1 + F.col("o_custkey") % 150), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "ADDED").otherwise("DELETED").alias("change_type"))
    return context.of_change(files, lines, symbols)


@query(_ITEMS + """, titled AS (SELECT *, CASE WHEN item_type = 'CHANGED_CODE' AND g != 'all' THEN 'Review changed ' || first_name ELSE 'Check ' || total || ' ' || coalesce(CASE via WHEN 'CALLS' THEN 'callers' WHEN 'REFERENCES' THEN 'dependents' WHEN 'IMPORTS' THEN 'dependent files' END, 'items') END AS title FROM items),
ent AS (SELECT * FROM (SELECT node, name, row_number() OVER (ORDER BY depth, name, node) AS n FROM typed WHERE item_type = 'UNRESOLVED_IMPACT') WHERE n <= 3)
SELECT lower(item_type) AS kind, stable_key AS name, priority || ' ' || title AS text FROM titled UNION ALL SELECT 'entry', node, name FROM ent WHERE (SELECT count(*) FROM items WHERE item_type = 'UNRESOLVED_IMPACT') > 0""")
def review_context(t):
    return context.of_review(review.items(made_nodes(t))).select("kind", "name", "text")


@query(MADE + _ROOTS + """, own AS (SELECT *, coalesce('S' || source_symbol_id, 'F' || evidence_file_id) AS owner FROM edges WHERE status = 'UNRESOLVED'),
k AS (SELECT owner, type, min_by(evidence, (start_line, evidence)) AS evidence FROM own WHERE owner IN (SELECT node FROM rt) GROUP BY owner, evidence_file_id, type, start_line),
w AS (SELECT 'S' || o_orderkey AS target, 'F' || 1 + o_custkey % 9 AS root FROM orders WHERE 'S' || o_orderkey IN (SELECT owner FROM k))
SELECT 'unresolved' AS kind, evidence AS name, type || ' ' || evidence AS text FROM k UNION ALL SELECT 'path', target, root || ' to ' || target FROM w""".replace("'F' || 1 + o_custkey % 9", "'F' || (1 + o_custkey % 9)"))
def unresolved_context(t):
    ends = impact.open_ends(made_roots(t)[1], made_edges(t), "UNRESOLVED", limit=1 << 30)
    paths = t("orders").select(F.concat(F.lit("F"), (1 + F.col("o_custkey") % 9).cast("string")).alias("root"), F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("target"), F.lit(1).alias("depth"))
    return context.of_unresolved(ends, paths).select("kind", "name", "text")


@query(MADE + "SELECT symbol_id, name, qualified_name, kind, path, line_start, line_end, parent FROM (SELECT s.*, path, p.qualified_name AS parent FROM symbols s JOIN files USING (file_id) LEFT JOIN (SELECT symbol_id AS parent_symbol_id, qualified_name FROM symbols) p USING (parent_symbol_id)) WHERE name = 'f8'")
def symbol_definitions(t):
    """The definition rows of all symbols of a name, with their parents."""
    from .plan_queries import made_files, made_symbols

    symbols = made_symbols(t)
    return search.definitions(symbols.where("name = 'f8'"), symbols, made_files(t)).select("symbol_id", "name", "qualified_name", "kind", "path", "line_start", "line_end", "parent")


# --- imports of scripts, edges of nodes, what a client shows

_SUFFIXES = "(VALUES ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('/index.ts', 5), ('/index.tsx', 6), ('/index.js', 7), ('/index.jsx', 8)) AS x(suffix, priority)"


@query(MADE + f""", i AS (SELECT event_id AS import_id, f.repository_id, 'f' || event_id % 97 AS imported_name, CASE event_id % 5 WHEN 0 THEN regexp_replace(path, '/[^/]*$', '') || '/m' || event_id % 200 WHEN 1 THEN 'src/pkg' || event_id % 5 || '/m' || event_id % 200 || '.ts' WHEN 2 THEN 'src/pkg' || event_id % 7 || '/m' || event_id % 200 END AS base
  FROM events JOIN files f ON f.file_id = 1 + user_id % 150),
hit AS (SELECT import_id, arg_min(f.file_id, priority) AS target_file_id FROM i, {_SUFFIXES} JOIN files f ON f.path = base || suffix AND f.repository_id = i.repository_id GROUP BY 1)
SELECT i.import_id, target_file_id, s.symbol_id AS target_symbol_id FROM i LEFT JOIN hit USING (import_id) LEFT JOIN symbols s ON s.file_id = target_file_id AND s.name = imported_name""")
def script_imports(t):
    """Imports of scripts: as they stand, with an extension or as a folder's index; packages stay open."""
    from .plan_queries import made_files, made_symbols

    key = F.col("event_id")
    number = (key % 200).cast("string")
    source = F.when(key % 5 == 0, F.concat(F.lit("./m"), number)).when(key % 5 == 1, F.concat(F.lit("../pkg"), (key % 5).cast("string"), F.lit("/m"), number, F.lit(".ts"))).when(key % 5 == 2, F.concat(F.lit("../../src/./pkg"), (key % 7).cast("string"), F.lit("/m"), number)).otherwise("react")
    rows = t("events").select(key.alias("import_id"), (1 + F.col("user_id") % 150).alias("file_id"), source.alias("source"), F.concat(F.lit("f"), (key % 97).cast("string")).alias("imported_name"), F.lit(None).cast("string").alias("alias"), F.lit("es_module").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return resolve.resolved_imports(made_files(t), made_symbols(t), rows).select("import_id", "target_file_id", "target_symbol_id")


@query(MADE + """, n AS (SELECT symbol_id FROM symbols WHERE name = 'f8') SELECT source_symbol_id AS touched, type, status, evidence_file_id, start_line FROM edges WHERE source_symbol_id IN (SELECT symbol_id FROM n)
UNION ALL SELECT target_symbol_id, type, status, evidence_file_id, start_line FROM edges WHERE target_symbol_id IN (SELECT symbol_id FROM n) AND source_symbol_id IS DISTINCT FROM target_symbol_id""")
def touching_edges(t):
    """The edges of many symbols at once, by two equi-joins."""
    from .operators import relational
    from .plan_queries import made_symbols

    nodes = made_symbols(t).where("name = 'f8'").select("symbol_id")
    return relational.either_end(made_edges(t), nodes, "source_symbol_id", "target_symbol_id", "symbol_id").select("touched", "type", "status", "evidence_file_id", "start_line")


@query("""WITH i AS (SELECT CASE p_size % 3 WHEN 0 THEN 'REQUIRED' WHEN 1 THEN 'RECOMMENDED' ELSE 'INFORMATIONAL' END AS priority, ['OPEN', 'DONE', 'SKIPPED'][p_partkey % 3 + 1] AS status, ['CHANGED_CODE', 'AFFECTED_TEST', 'AFFECTED_CALLER', 'UNRESOLVED_IMPACT', 'EXTERNAL_DEPENDENCY'][p_partkey % 5 + 1] AS item_type FROM part)
SELECT 'all' AS filter, count(*) AS n FROM i UNION ALL SELECT 'required', count(*) FROM i WHERE priority = 'REQUIRED' UNION ALL SELECT 'open', count(*) FROM i WHERE status = 'OPEN' UNION ALL SELECT 'done', count(*) FROM i WHERE status = 'DONE'
UNION ALL SELECT 'tests', count(*) FROM i WHERE item_type = 'AFFECTED_TEST' UNION ALL SELECT 'callers', count(*) FROM i WHERE item_type = 'AFFECTED_CALLER' UNION ALL SELECT 'unresolved', count(*) FROM i WHERE item_type IN ('UNRESOLVED_IMPACT', 'EXTERNAL_DEPENDENCY')""")
def filter_counts(t):
    """How many items each named filter shows."""
    pick = lambda names, key: F.get(F.array(*[F.lit(x) for x in names]), F.col(key) % len(names))
    items = t("part").select(pick(("REQUIRED", "RECOMMENDED", "INFORMATIONAL"), "p_size").alias("priority"), pick(("OPEN", "DONE", "SKIPPED"), "p_partkey").alias("status"), pick(("CHANGED_CODE", "AFFECTED_TEST", "AFFECTED_CALLER", "UNRESOLVED_IMPACT", "EXTERNAL_DEPENDENCY"), "p_partkey").alias("item_type"), F.col("p_size").alias("sort"), F.col("p_partkey").alias("stable_key"))
    parts = [views.filtered_items(items, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n") for name in views.item_filters()]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


_LISTED = "SELECT part, md5(string_agg(name, ',' ORDER BY depth, file_path, name, node)) AS names, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY depth, file_path, name, node) AS k FROM shown) WHERE k <= 1000 GROUP BY 1"


@query(MADE + _ROOTS + """, shown AS (SELECT CASE WHEN impact_class = 'DIRECT' THEN CASE node_type WHEN 'SYMBOL' THEN 'changed_symbols' ELSE 'changed_files' END WHEN is_test THEN 'tests' ELSE 'potential' END AS part, depth, file_path, name, node FROM (SELECT 'S' || o_orderkey AS node, CASE WHEN o_orderkey % 3 = 0 THEN 'FILE' ELSE 'SYMBOL' END AS node_type, 'n' || o_orderkey AS name, 'p' || o_custkey AS file_path,
  ['DIRECT', 'POTENTIAL', 'POTENTIAL', 'UNRESOLVED', 'EXTERNAL'][o_orderkey % 5 + 1] AS impact_class, (o_orderkey % 5 + o_custkey % 2)::INT AS depth, o_orderkey % 5 = 2 AND o_custkey % 2 = 0 AS is_test FROM orders) WHERE impact_class IN ('DIRECT', 'POTENTIAL')),
own AS (SELECT *, coalesce('S' || source_symbol_id, 'F' || evidence_file_id) AS owner FROM edges WHERE status = 'UNRESOLVED'),
u AS (SELECT evidence_file_id, start_line, min_by(evidence, (start_line, evidence)) AS evidence FROM own WHERE owner IN (SELECT node FROM rt) GROUP BY owner, evidence_file_id, type, start_line ORDER BY 1, 2, 3 LIMIT 500)
""" + _LISTED + " UNION ALL SELECT 'unresolved', md5(string_agg(evidence, ',' ORDER BY evidence_file_id, start_line, evidence)), count(*) FROM u")
def impact_rendered(t):
    """The ordered arrays of an impact, 1000 entries at most each."""
    nodes = made_nodes(t).where("impact_class IN ('DIRECT', 'POTENTIAL')")
    ends = impact.open_ends(made_roots(t)[1], made_edges(t), "UNRESOLVED", limit=500)
    row = saved(impact.rendered(nodes, ends, ends.limit(0)))
    parts = {"changed_symbols": "name", "changed_files": "name", "potential": "name", "tests": "name", "unresolved": "evidence"}
    each = F.array(*[F.struct(F.lit(n).alias("part"), F.md5(F.array_join(F.col(f"{n}.{c}"), ",")).alias("names"), F.size(n).cast("long").alias("n")) for n, c in parts.items()])
    return row.select(F.explode(each).alias("x")).select("x.*").where("n > 0")
