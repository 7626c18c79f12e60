import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalar as s
from codeloom.operators import lines, relational, traversal
from codeloom.plans import diff, extract, impact, resolve, review, search
from codeloom.sources import files as src

TREE = {
    "stock/__init__.py": "",
    "stock/ledger.py": "class Ledger:\n    def post_entry(self, t):\n        return measure(t)\n\n\ndef measure(t):\n    return len(t)\n",
    "stock/report.py": "import os, sys\nfrom stock.ledger import Ledger, measure\n\n\nasync def render(x):\n    book = Ledger()\n    return measure(x) + unknown(x)\n",
    "people/roles.py": "from stock.ledger import Ledger\n\n\nclass AuditLedger(Ledger):\n    pass\n",
    "people/rel.py": "from ..stock import ledger\nfrom .missing import x\n",
    "tests/test_ledger.py": "from stock.ledger import Ledger\n\n\ndef test_it():\n    assert Ledger()\n",
    "broken.py": "def broken(:\n",
    "web/app.ts": "export const a = 1;\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(p, t) for p, t in TREE.items()]
    files = src.numbered(spark.createDataFrame(rows, "path string, content string").withColumn("language", s.language_of(F.col("path"))).withColumn("size_bytes", F.length("content")))
    files = spark.createDataFrame(files.collect(), files.schema)
    parsed = extract.parsed(files).collect()
    parsed = spark.createDataFrame(parsed, extract.SCHEMA)
    symbols = spark.createDataFrame(extract.symbols(parsed).collect(), extract.symbols(parsed).schema)
    imports = spark.createDataFrame(extract.imports(parsed).collect(), extract.imports(parsed).schema)
    edges = resolve.relationships(files, symbols, imports)
    return files, parsed, symbols, imports, spark.createDataFrame(edges.collect(), edges.schema)


def bare(qualified, path):
    """A qualified name without the module of its file."""
    return qualified.removeprefix(path.rsplit(".", 1)[0].removesuffix("/__init__").replace("/", ".") + ".")


def named(tree):
    files, _, symbols, _, edges = tree
    path = {r["file_id"]: r["path"] for r in files.collect()}
    name = {r["symbol_id"]: bare(r["qualified_name"], path[r["file_id"]]) for r in symbols.collect()}
    return {(r["type"], r["status"], name.get(r["source_symbol_id"]) or path[r["evidence_file_id"]], name.get(r["target_symbol_id"]) or path.get(r["target_file_id"])) for r in edges.collect()}


def test_parsing(tree):
    files, parsed, symbols, imports, _ = tree
    status = {r["path"]: r["status"] for r in parsed.join(files, "file_id").collect()}
    assert status["broken.py"] == "syntax_error" and status["web/app.ts"] == "parsed" and status["stock/ledger.py"] == "parsed"
    path = {r["file_id"]: r["path"] for r in files.collect()}
    rows = symbols.where("kind != 'IMPORT'").collect()
    got = {bare(r["qualified_name"], path[r["file_id"]]): r for r in rows}
    assert "stock.ledger.Ledger.post_entry" in {r["qualified_name"] for r in rows}
    assert "broken" in got and got["render"]["kind"] == "ASYNC_FUNCTION" and got["Ledger.post_entry"]["kind"] == "FUNCTION"
    assert (got["Ledger"]["line_start"], got["Ledger"]["line_end"]) == (1, 3) and got["measure"]["signature"] == "measure(t)"
    assert {(r["source"], r["imported_name"]) for r in imports.collect()} >= {("os", None), ("stock.ledger", "measure"), ("..stock", "ledger"), (".missing", "x")}


def test_relationships(tree):
    edges = named(tree)
    assert ("DEFINES", "RESOLVED", "Ledger", "Ledger.post_entry") in edges
    assert ("CALLS", "RESOLVED", "Ledger.post_entry", "measure") in edges and ("CALLS", "RESOLVED", "Ledger", "measure") in edges
    assert ("CALLS", "RESOLVED", "render", "Ledger") in edges and ("CALLS", "UNRESOLVED", "render", None) in edges
    assert ("EXTENDS", "RESOLVED", "AuditLedger", "Ledger") in edges
    assert ("TESTS", "RESOLVED", "tests/test_ledger.py", "Ledger") in edges
    assert ("REFERENCES", "RESOLVED", "render", "Ledger") in edges
    assert ("IMPORTS", "EXTERNAL", "stock/report.py", None) in edges and ("IMPORTS", "UNRESOLVED", "people/rel.py", None) not in {e for e in edges if e[3]}
    external = [e for e in tree[4].collect() if e["status"] == "EXTERNAL"]
    assert len(external) == 1  # one line of external imports is one edge


def test_search_and_investigation(tree):
    files, _, symbols, _, edges = tree
    best = search.search(files, symbols, "Ledger").collect()
    assert best[0]["kind"] == "CLASS" and best[0]["score"] == 5
    assert search.search(files, symbols, "stock", "file").collect()[0]["path"].startswith("stock/")
    assert [(r["path"], r["line_number"]) for r in search.search(files, symbols, "return LEN", "text").collect()] == [("stock/ledger.py", 7)]
    for bad in ("", "*", "x" * 201, "a\nb"):
        with pytest.raises(ValueError):
            search.checked_query(bad)
    target = next(r["symbol_id"] for r in symbols.collect() if r["qualified_name"] == "stock.ledger.Ledger" and r["kind"] == "CLASS")
    around = search.investigate(edges, symbols, files, target)
    assert {"callers", "dependencies", "tests", "references"} <= {r["group"] for r in around.collect()}
    assert "tests/test_ledger.py" in [r["path"] for r in search.related_files(around, files).collect()]


def test_a_neighbourhood_is_whole(spark):
    edges = spark.range(3000).select(F.lit(8).cast("long").alias("source_symbol_id"), (F.col("id") + 100).alias("target_symbol_id"), F.lit("CALLS").alias("type"), F.lit("RESOLVED").alias("status"), F.col("id").alias("evidence_file_id"), F.lit(1).alias("start_line"), F.lit(None).cast("long").alias("target_file_id"))
    symbols = spark.range(4000).select(F.col("id").alias("symbol_id"), F.lit("f").alias("name"), F.lit("m.f").alias("qualified_name"))
    files = spark.range(3000).select(F.col("id").alias("file_id"), F.format_string("p%04d", "id").alias("path"))
    around = search.investigate(edges, symbols, files, 8)
    assert around.count() == 3000 and search.investigate(edges, symbols, files, 8, limit=10).count() == 10
    assert search.related_files(around, files, limit=5000).count() == 3000


DIFF = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -5,3 +5,4 @@ def f\n a\n-b\n+c\n+++d\n e\n"


def test_hunks_number_their_lines(spark):
    df = spark.createDataFrame([(1, DIFF), (2, "")], "file_id long, diff string")
    rows = lines.hunks(df, ["file_id"]).collect()
    assert [(r["side"], r["old_line"], r["new_line"]) for r in rows] == [(None, 5, 5), ("OLD", 6, None), ("NEW", None, 6), ("NEW", None, 7), (None, 7, 8)]
    assert [(r["side"], r["line_number"]) for r in lines.changed_lines(lines.hunks(df, ["file_id"])).collect()] == [("OLD", 6), ("NEW", 6), ("NEW", 7)]


def test_hunks_are_numbered_where_they_stand(spark):
    """Many diffs in a batch, bare ones, empty ones and marks of no newline: equal to a plain loop, and without an exchange."""
    import random
    import re

    r = random.Random(3)
    texts = ["\n".join(r.choice(["--- a/x", "+a", "-b", " c", "", "\\ No newline", "@@ -3,2 +4,3 @@ f", "@@ -7 +9 @@", "@@ -x", "é", "@@ -1"]) for _ in range(r.randint(0, 30))) for _ in range(200)]
    want = []
    for key, text in enumerate(texts):
        hunk = 0
        for place, line in enumerate(text.split("\n")):
            if re.match(r"@@ -\d", line):
                m = re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line)
                hunk, old, new = hunk + 1, int(m[1]) if m else 1, int(m[2]) if m else 1
            elif hunk and line and line[0] != "\\":
                want.append((key, hunk, place, None if line[0] == "+" else old, None if line[0] == "-" else new, line[1:]))
                old, new = old + (line[0] != "+"), new + (line[0] != "-")
    numbered = lines.hunks(spark.createDataFrame([*enumerate(texts), (999, None)], "k long, diff string"), ["k"])
    assert sorted(tuple(x) for x in numbered.select("k", "hunk", "place", "old_line", "new_line", "text").collect()) == sorted(want, key=lambda x: x[:3])
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_diff_impact_and_review(spark, tree):
    files, _, symbols, _, edges = tree
    ids = {r["path"]: r["file_id"] for r in files.collect()}
    diffs = spark.createDataFrame([(ids["stock/ledger.py"], "@@ -7,1 +7,1 @@\n-    return 0\n+    return len(t)\n")], "file_id long, diff string")
    changed, mapped = diff.analysed(diffs, symbols)
    assert [(r["name"], r["added_lines"], r["deleted_lines"], r["change_type"]) for r in mapped.collect()] == [("measure", 1, 1, "MODIFIED")]
    changes = diff.linked(spark.createDataFrame([("stock/ledger.py", None, 1, 1)], "path string, old_path string, additions int, deletions int"), files)
    assert diff.totals(changes, mapped).collect()[0]["symbols_changed"] == 1
    roots = impact.roots(mapped, changes, files)
    nodes = impact.traversed(roots, edges, symbols, files, 2)
    by_name = {bare(r["name"], r["file_path"]): r for r in nodes.collect() if r["node_type"] == "SYMBOL"}
    assert by_name["render"]["depth"] == 1 and by_name["render"]["via"] == "CALLS"
    assert by_name["Ledger.post_entry"]["depth"] == 1 and [x["kind"] for x in by_name["AuditLedger"]["path"]] == ["CALLS", "EXTENDS"]
    assert [x["at"] for x in by_name["AuditLedger"]["path"]] == ["stock/ledger.py:3", "people/roles.py:4"]
    row = impact.summary(nodes, impact.open_ends(roots, edges, "UNRESOLVED"), impact.open_ends(roots, edges, "EXTERNAL")).collect()[0]
    assert (row["changed_symbols"], row["changed_files"], row["total_direct"], row["truncated"]) == (1, 1, 2, False)
    cut = impact.traversed(roots, edges, symbols, files, 2, limit=3)  # two roots count
    assert cut.where("depth > 0").count() == 1 and cut.where("truncated").count() == 3
    cut = impact.traversed(roots, edges, symbols, files, 2, limit=1)
    assert [(r["depth"], r["rank"]) for r in cut.collect()] == [(0, 1)]
    assert impact.paths(nodes).count() > 0
    listed = nodes.withColumns({"category": s.file_category(F.col("file_path")), "file_level": F.lit(False)})
    items = review.items(listed).collect()
    assert items[0]["item_type"] == "CHANGED_CODE" and items[0]["priority"] == "REQUIRED"
    assert {i["item_type"] for i in items} >= {"CHANGED_CODE", "AFFECTED_CALLER"}


def test_snapshots(spark):
    a = spark.createDataFrame([("a.py", "1"), ("b.py", "2"), ("c.md", "3"), ("same", "s")], "path string, content string")
    b = spark.createDataFrame([("a.py", "9"), ("d.py", "2"), ("e.py", "5"), ("same", "s")], "path string, content string")
    got = {r["path"]: (r["status"], r["old_path"]) for r in diff.snapshot_diff(a, b).collect()}
    assert got == {"a.py": ("MODIFIED", None), "d.py": ("RENAMED", "b.py"), "e.py": ("ADDED", None), "c.md": ("DELETED", None)}


def test_traversal_takes_first_discoverer(spark):
    roots = spark.createDataFrame([("a", "0"), ("b", "1")], "node string, rank string")
    edges = spark.createDataFrame([("a", "x", "K"), ("b", "x", "J"), ("x", "y", "K"), ("y", "a", "K"), ("y", "z", "K")], "source string, target string, kind string")
    got = {r["node"]: (r["depth"], r["root"]) for r in traversal.bounded_bfs(roots, edges, 2).collect()}
    assert got == {"a": (0, "a"), "b": (0, "b"), "x": (1, "a"), "y": (2, "a")}


def test_review_carries_state_over(spark):
    new = spark.createDataFrame([("k1", [("e1", "OPEN"), ("e2", "OPEN")]), ("k2", [])], "stable_key string, entries array<struct<entry_key string, status string>>")
    old = spark.createDataFrame([("k1", "DONE", "n", [("e2", "DONE")])], "stable_key string, status string, notes string, entries array<struct<entry_key string, status string>>")
    got = {r["stable_key"]: r for r in review.carried(new, old).collect()}
    assert got["k1"]["status"] == "DONE" and got["k2"]["status"] == "OPEN" and [e["status"] for e in got["k1"]["entries"]] == ["OPEN", "DONE"]


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0]["x"]
    lit = F.lit
    assert [one(s.module_of_path(lit(p))) for p in ("a/b.py", "a/__init__.py", "a\\c.py", "__init__.py")] == ["a.b", "a", "a.c", ""]
    assert [one(s.file_category(lit(p))) for p in ("setup.py", ".github/x", "README.md", "docs/a.md", "a/b/c.md", "tests/a.py", "a_test.py", "a.py", "x")] == ["CONFIG", "CONFIG", "DOCUMENTATION", "DOCUMENTATION", "UNKNOWN", "TEST", "TEST", "SOURCE", "UNKNOWN"]
    assert one(s.redact_text(lit('API_KEY="abc"; password = x\x00, ok'))) == "API_KEY=REDACTED; password=REDACTED, ok"
    assert one(s.repository_of(lit("https://github.com/o/r.git")))["name"] == "r" and one(s.repository_of(lit("http://github.com/o/r"))) is None
    assert [one(s.line_count(lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert one(s.numstat_path(lit("a/{x => y}/z"))) == "a/y/z" and one(s.snippet(lit("a\nb\nc"), lit(2), lit(9))) == "b\nc"
    assert [one(s.is_test_file(lit(p))) for p in ("test_a.py", "tests/a.py", "tests/test_a.rb", "a.test.ts")] == [True, False, True, True]
    assert one(s.share(lit(1), lit(3))) == 33.3 and one(s.layout_module(lit("src.pkg.a"))) == "pkg.a"


def test_relational_operators(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (None, "c", 1), (None, "d", 2)], "k int, v string, o int")
    assert {(r["k"], r["v"]) for r in relational.first_wins(df, ["k"], ["o"]).collect()} == {(1, "b"), (None, "c")}
    assert [r["o"] for r in relational.within_budget(df, "o", ["v"], 9).collect()] == [5, 3, 1]
    assert [r["o"] for r in relational.until_spent(df, "o", ["v"], 6).collect()] == [5, 3]
    rows, cut = relational.capped(df, ["v"], 2)
    assert rows.count() == 2 and cut.collect()[0]["truncated"]


def test_files_source(spark, tmp_path):
    for p, t in {"a/b.py": "x = 1\n", "node_modules/x.js": "1", "yarn.lock": "", "bad.py": "\xff"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t.encode("latin-1"))
    got = {r["path"]: r for r in src.read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/b.py", "bad.py"} and got["a/b.py"]["language"] == "Python" and got["a/b.py"]["line_count"] == 1 and got["bad.py"]["content"] == "�"
    with pytest.raises(src.LimitExceeded):
        src.checked(src.read_files(spark, str(tmp_path)), max_files=1)


def test_search_ranks_all_matches_and_reads_all_files(spark):
    n = 6000
    symbols = spark.range(n).selectExpr("id AS symbol_id", "id AS file_id", f"if(id = {n - 1}, 'al', concat('xalx', id)) AS name", "concat('m.', name) AS qualified_name", "'CLASS' AS kind")
    files = spark.range(n).selectExpr("id AS file_id", f"if(id = {n - 1}, 'al', concat('xalx', id)) AS path")
    assert search.search_symbols(symbols, files, "al", limit=1).collect()[0]["symbol_id"] == n - 1
    assert search.search_files(files, symbols, "al", limit=1).collect()[0]["file_id"] == n - 1
    assert search.search_symbols(symbols, files, "al", limit=1, candidates=5000).collect()[0]["symbol_id"] < 5000
    texts = spark.createDataFrame([("a", "nothing", 40 << 20), ("b", "needle\n" * 1500, 7)], "path string, content string, size_bytes long")
    assert search.search_text(texts, "needle", limit=2000).count() == 1500
    assert search.search_text(texts, "needle", budget=32 << 20).count() == 0


def test_same_file_references_and_dotted_bases(spark):
    tree = {
        "base/models.py": "class Entity:\n    pass\n",
        "shop/models.py": "import base.models\n\n\nclass Entity(base.models.Entity):\n    pass\n\n\ndef measure():\n    return 1\n\n\ndef use():\n    f = measure\n    return f\n",
    }
    rows = [(i, p, t, "Python") for i, (p, t) in enumerate(tree.items())]
    files = spark.createDataFrame(rows, "file_id long, path string, content string, language string")
    parsed = extract.parsed(files)
    symbols = extract.symbols(parsed)
    edges = resolve.relationships(files, symbols, extract.imports(parsed)).collect()
    name = {r["symbol_id"]: (r["file_id"], r["name"]) for r in symbols.collect()}
    got = {(e["type"], e["status"], name.get(e["source_symbol_id"]), name.get(e["target_symbol_id"])) for e in edges}
    assert ("EXTENDS", "RESOLVED", (1, "Entity"), (0, "Entity")) in got
    assert ("REFERENCES", "RESOLVED", (1, "use"), (1, "measure")) in got


@pytest.mark.parametrize("bad", ["print 'x'", "<<<<<<< HEAD", "x = = 1", "def (:"])
def test_symbols_after_a_syntax_error(bad):
    source = f'import os\n\n\nclass A:\n    """Text\nat the margin."""\n\n    def a(self):\n        {bad}\n\n    def b(self, x=1):\n        return x\n\n\n{bad}\n\n\n@deco\ndef c(y):\n    return y\n\n\nfrom m import d\n'
    status, symbols, imports = extract._python(source)
    assert status == "syntax_error" and [i["source"] for i in imports] == ["os", "m"]
    got = {s["qualified_name"]: (s["line_start"], s["line_end"]) for s in symbols}
    assert got["A.b"] == (11, 12) and got["c"] == (19, 20) and "A.a" in got and got["A"][0] == 4
    assert {s["qualified_name"]: s["signature"] for s in symbols}["A.b"] == "b(self, x=1)"


def test_caps_of_a_key_without_a_task_for_it(spark):
    """3000 rows of one key and few of others: the cap holds, and no window goes over the key alone."""
    rows = spark.range(3000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 3000).alias("v")).union(spark.range(10).select(F.lit("rare"), F.col("id")))
    for limit in (1, 10, 1500, 2999, 3000):
        got = relational.capped_per_key(rows.repartition(7), ["k"], ["v"], limit)
        want = {("hot", n) for n in range(min(limit, 3000))} | {("rare", n) for n in range(min(limit, 10))}
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = relational.capped_per_key(rows, ["k"], ["v"], 1500)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_range" in line for line in plan.splitlines() if "windowspecdefinition" in line)


def test_lists_of_first_rows_hold_few_rows_a_task(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    listed = relational.first_listed(rows, ["k"], ["v"], F.col("v"), 200)
    assert {r["k"]: r["entries"] for r in listed.collect()} == {k: list(range(k, 400, 2)) for k in (0, 1)}
    assert listed._jdf.queryExecution().sparkPlan().toString().count("WindowGroupLimit") == 2  # before the exchange and after it


def test_checklists_list_steps_and_hide_secrets(spark):
    node = "node string, node_type string, name string, file_path string, category string, impact_class string, depth int, via string, is_test boolean, file_level boolean"
    rows = [("S1", "SYMBOL", "password=hunter2", "a.py", "SOURCE", "DIRECT", 0, None, False, False)]
    rows += [(f"S{k}", "SYMBOL", f"n{k:04d}", "b.py", "SOURCE", "POTENTIAL", 1, "CALLS", False, False) for k in range(10, 300)]
    paths = spark.createDataFrame([("S1", "S10", "n0010", 1, [("S1", "CALLS", "S10", "b.py:4")]), ("S9", "S10", "n0010", 2, [])], "root string, target string, target_name string, depth int, path array<struct<source: string, kind: string, target: string, at: string>>")
    items = {r["item_type"]: r for r in review.items(spark.createDataFrame(rows, node), paths).collect()}
    assert items["CHANGED_CODE"]["title"] == "Review changed password=REDACTED" and "hunter2" not in str(items["CHANGED_CODE"]["entries"])
    callers = items["AFFECTED_CALLER"]
    assert (callers["total"], len(callers["entries"]), callers["note"]) == (290, 200, "Showing the first 200 of 290 entries.")
    assert [e["entry_key"] for e in callers["entries"][:3]] == ["S10", "S11", "S12"]
    assert [tuple(x) for x in callers["entries"][0]["path_steps"]] == [("S10", "CALLS", "S1", "b.py:4")] and callers["entries"][1]["path_steps"] == []


def test_resolvers_broadcast_by_measured_sizes_only(spark, tree):
    """Exploded lines of files whose table is small on disk are not broadcast by its size: the plan has no broadcast before it runs."""
    files, _, symbols, imports, _ = tree
    bound = resolve.bindings(resolve.resolved_imports(files, symbols, imports))
    for edges in (resolve.calls(files, symbols, bound), resolve.references(files, symbols, bound), resolve.tests(files, bound), resolve.extends(files, symbols, bound)):
        assert "BroadcastHashJoin" not in edges._jdf.queryExecution().executedPlan().toString()
