"""The whole way of one repository: read, parse, graph, search, diff, impact, checklist, contexts, removal."""

import pytest

from pyspark.sql import functions as F

from codeloom.plans import diff
from codeloom.publication import Refused
from codeloom.workspace import Missing, Workspace

TREE = {
    "shop/cart.py": "from shop.price import total\n\n\nclass Cart:\n    def pay(self, items):\n        return total(items)\n",
    "shop/price.py": "def total(items):\n    return add(items)\n\n\ndef add(items):\n    return sum(items)\n",
    "shop/desk.py": "import json\nfrom shop.cart import Cart\n\n\ndef serve(x):\n    gone(x)\n    return Cart()\n",
    "web/view.ts": "export function draw(x: number) { return x; }\n",
    "README.md": "# Shop\n",
}
DIFF = "--- a/shop/price.py\n+++ b/shop/price.py\n@@ -1,2 +1,2 @@\n def total(items):\n-    return 0\n+    return add(items)  # password = hunter2\n"


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    folder, root = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("space")
    for p, t in TREE.items():
        (folder / p).parent.mkdir(parents=True, exist_ok=True)
        (folder / p).write_text(t)
    w = Workspace(spark, str(root))
    for k in (1, 2):
        assert w.ingest(k, "https://github.com/o/shop", str(folder)).collect()[0]["name"] == "shop"
        w.parse(k)
        w.build_relationships(k)
    changes = spark.createDataFrame([("shop/price.py", None, "M", 1, 1), ("README.md", None, "M", 1, 0)], "path string, old_path string, code string, additions int, deletions int")
    w.compare(1, 5, changes, spark.createDataFrame([("shop/price.py", DIFF)], "path string, diff string"))
    w.analyse_impact(1, 5)
    w.make_review(1, 5)
    return w


def test_tables(space):
    assert [r["repository_id"] for r in space.repositories().collect()] == [2, 1] and space.health().collect()[0]["status"] == "ok"
    with pytest.raises(ValueError):
        space.ingest(3, "ftp://x", "/nowhere")
    with pytest.raises(Missing):
        space.symbols(9)
    assert {r["status"]: r["files"] for r in space.analysis(1).collect()} == {"parsed": 4, "unsupported": 1}
    assert space.languages(1).collect()[0]["language"] == "Python"
    assert space.content(1, "shop/price.py", 1, 1).collect()[0]["content"] == "def total(items):" and space.content(1, "../x").count() == 0
    rows = space.symbols(1, name="a", kind="class").collect()
    assert [(r["name"], r["total"]) for r in rows] == [("Cart", 1)] and space.symbol(1, rows[0]["symbol_id"]).count() == 1
    assert space.imports(1, source="shop").count() == 2 and [r["name"] for r in space.exports(1).collect()] == ["draw"]
    assert {r["target_name"] for r in space.relationships(1, type="calls", source="pay").collect()} == {"total"}
    assert space.search(1, "Cart").collect()[0]["kind"] == "CLASS" and space.search(1, "add(", "text").count() == 2
    assert [(r["path"], r["parent"]) for r in space.definition(1, rows[0]["symbol_id"]).collect()] == [("shop/cart.py", None)]
    assert {r["total"] for r in space.search(1, "add(", "text").collect()} == {2}
    assert "callers" in {r["group"] for r in space.investigation(1, rows[0]["symbol_id"]).collect()}
    assert "shop/cart.py" in {r["path"] for r in space.related_files(1, rows[0]["symbol_id"]).collect()} and space.neighbours(1, rows[0]["symbol_id"], 3).count() == 3


def test_change_to_checklist(space):
    total = space.diff(1, 5).collect()[0]
    assert (total["files_changed"], total["insertions"], total["deletions"], total["symbols_changed"]) == (2, 2, 1, 1)
    assert [r["path"] for r in space.diff_files(1, 5).collect()] == ["README.md", "shop/price.py"] and [r["name"] for r in space.diff_symbols(1, 5).collect()] == ["total"]
    file_id = space.diff_symbols(1, 5).collect()[0]["file_id"]
    assert [(r["side"], r["line_number"]) for r in space.diff_file(1, 5, file_id).collect()] == [("NEW", 2), ("OLD", 2)]
    row = space.impact_summary(1, 5).collect()[0]
    assert (row["changed_symbols"], row["changed_files"], row["truncated"]) == (1, 2, False)
    names = {e["name"] for e in space.impact(1, 5).collect()[0]["potential"]}
    assert {"shop.cart.Cart.pay", "shop/cart.py"} <= names
    items = {r["stable_key"]: r for r in space.review(1, 5).collect()}
    assert {"DOCUMENTATION_CHANGE", "CHANGED_CODE", "AFFECTED_CALLER"} <= {r["item_type"] for r in items.values()}
    key = next(k for k, r in items.items() if r["item_type"] == "AFFECTED_CALLER")
    entry = items[key]["entries"][0]["entry_key"]
    space.update_item(1, 5, key, "DONE", "seen")
    space.update_item(1, 5, key, "DONE", entry_key=entry)
    for _ in range(2):  # made again, the checklist keeps its state
        got = {r["stable_key"]: r for r in space.review(1, 5).collect()}[key]
        assert (got["status"], got["notes"]) == ("DONE", "seen") and next(e for e in got["entries"] if e["entry_key"] == entry)["status"] == "DONE"
        space.make_review(1, 5)
    assert space.review_counters(1, 5).collect()[0]["done"] == 1
    assert {r["kind"] for r in space.recent().collect()} == {"repository", "diff", "review"}


def test_depths_side_by_side_and_updates_that_are_refused(space):
    space.analyse_impact(1, 5, 3)
    deep, near = (space.impact_summary(1, 5, d).collect()[0] for d in (3, 2))
    assert deep["potential"] >= near["potential"] and space.results.current("impact", {"repository_id": 1, "diff_id": 5, "depth": 2})["number"] == 1
    with pytest.raises(Missing):
        space.impact(1, 5, 4)
    key = space.review(1, 5).collect()[0]["stable_key"]
    for bad in (("none", "DONE", None), (key, "LATER", None), (key, "DONE", "none")):
        with pytest.raises(Refused):
            space.update_item(1, 5, bad[0], bad[1], entry_key=bad[2])
    before = [tuple(r) for r in space.review(1, 5).collect()]
    space.compact_log(1, 5)
    assert [tuple(r) for r in space.review(1, 5).collect()] == before


def test_diffs_by_revision_and_of_snapshots(spark, space):
    changes = spark.createDataFrame([("shop/price.py", None, "M", 1, 1)], "path string, old_path string, code string, additions int, deletions int")
    texts = spark.createDataFrame([("shop/price.py", DIFF)], "path string, diff string")
    first = space.compare_revisions(1, "aaa", "bbb", changes, texts)
    assert space.compare_revisions(1, "aaa", "bbb", changes.limit(0), texts) == first and space.diff_files(1, first).count() == 1
    with pytest.raises(diff.SameRevision):
        space.compare_revisions(1, "aaa", "aaa", changes, texts)
    head = spark.createDataFrame(list(TREE.items()), "path string, content string")
    old = dict(TREE) | {"shop/price.py": TREE["shop/price.py"].replace("add(items)", "0", 1), "shop/old_desk.py": TREE["shop/desk.py"] + "# gone\n"}
    del old["shop/desk.py"]
    base = spark.createDataFrame(list(old.items()), "path string, content string")
    made = space.compare_snapshots(1, base, head)
    rows = {r["path"]: (r["status"], r["old_path"], r["additions"], r["deletions"]) for r in space.diff_files(1, made).collect()}
    assert rows == {"shop/price.py": ("MODIFIED", None, 1, 1), "shop/desk.py": ("RENAMED", "shop/old_desk.py", 0, 1)}
    assert [r["name"] for r in space.diff_symbols(1, made).collect()] == ["total"]
    file_id = space.diff_symbols(1, made).collect()[0]["file_id"]
    hunk = space.diff_hunks(1, made, file_id).collect()[0]
    assert (hunk["old_start"], hunk["new_start"]) == (1, 1) and "-    return 0\n+    return add(items)" in hunk["content"]
    with pytest.raises(diff.SameRevision):
        space.compare_snapshots(1, head, head.orderBy(F.desc("path")))


def test_lenses_are_cut_and_redacted(space):
    texts = {kind: "\n".join(r["text"] for r in space.lens(1, 5, kind).collect()) for kind in ("change", "impact", "review", "unresolved")}
    assert "password=REDACTED" in texts["change"] and "hunter2" not in texts["change"]
    assert "shop.cart.Cart.pay" in texts["impact"] and "REQUIRED" in texts["review"]
    assert "README" not in "\n".join(r["text"] for r in space.lens(1, 5, "change", "shop/price.py").collect())
    with pytest.raises(ValueError):
        space.lens(1, 5, "other")


def test_removal(space):
    space.remove(2)
    assert [r["repository_id"] for r in space.repositories().collect()] == [1]
    with pytest.raises(Missing):
        space.symbols(2)
