"""Case folding and explanations against Python, and a listing that stops."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import explanation, folding
from codeloom.functions import values as v
from codeloom.plans import search
from codeloom.sources import files as src


def test_folding_is_that_of_python(spark):
    """Every character by itself; the characters for which it differs, as Java and Python know other versions of Unicode, are few."""
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    words = ["Straße", "STRASSE", "ΣΑΣ", "σας", "ὈΔΥΣΣΕΎΣ", "İstanbul", "ﬃ", "ẞ", "K", "Dž", "", "ΐ x ß"]
    rows = spark.createDataFrame([(c,) for c in every + words], "c string").select("c", folding.casefold(F.col("c")).alias("f")).collect()
    other = {r["c"] for r in rows if r["f"] != r["c"].casefold()}
    assert not other & set(words) and len(other) < 150 and all(ord(c) > 0x1C80 for c in other)


def test_searches_fold(spark):
    rows = [(1, "straße", "m.straße"), (2, "STRASSE", "m.STRASSE"), (3, "σας", "m.σας"), (4, "İx", "m.İx")]
    symbols = spark.createDataFrame([(k, k, n, q, "CLASS") for k, n, q in rows], "symbol_id long, file_id long, name string, qualified_name string, kind string")
    files = spark.createDataFrame([(k, f"{k}.py", f"a {n} b", 9) for k, n, _ in rows], "file_id long, path string, content string, size_bytes int")
    hits = lambda q: [r["path"] for r in search.search_text(files, q).collect()]
    assert hits("Strasse") == ["1.py", "2.py"] and hits("ΣΑΣ") == ["3.py"] and hits("i̇X") == ["4.py"]
    scores = {r["name"]: r["score"] for r in search.search_symbols(symbols, files, "ΣΑς").collect()}
    assert scores in ({}, {"σας": 3})  # ILIKE finds the candidates, as the database of a service would


def brute(raw):
    clean = lambda x, n: "" if x is None else " ".join((x if isinstance(x, str) else str(x)).split())[:n]
    text = raw.strip()
    if text.startswith("```"):
        text = re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z0-9_-]*\s*", "", text)).strip()
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b <= a:
        return explanation.NO_OBJECT
    try:
        obj = json.loads(text[a : b + 1])
    except ValueError:
        return explanation.NOT_JSON
    summary = clean(obj.get("summary"), 700)
    if not summary:
        return explanation.NO_SUMMARY
    if not isinstance(obj.get("evidence_indices"), list):
        return explanation.NO_LIST
    whole = [x for x in obj["evidence_indices"] if isinstance(x, int) and not isinstance(x, bool)]
    if not whole:
        return explanation.NO_INDICES
    checks = obj.get("suggested_checks")
    checks = [c for c in (clean(x, 200) for x in (checks if isinstance(checks, list) else [])) if c]
    return summary, whole[:6], clean(obj.get("uncertainty"), 400) or None, checks[:4]


def test_explanations(spark):
    good = '{"summary": "s  t\\n u", "evidence_indices": [2, 1]}'
    replies = [good, f"```json\n{good}\n```", f"```\n{good}```  ", f"so {good} {{", f"x {good} y", "", "   ", "no", "{}", "}{", "{", "[1]", "{]}", '{"summary": null, "evidence_indices": [1]}', '{"summary": true, "evidence_indices": [1]}']
    replies += [json.dumps({"summary": "x" * 900, "evidence_indices": list(range(20)), "uncertainty": "u" * 500, "suggested_checks": ["c" * 300, " ", None, 3, "e", "f", "g"]})]
    replies += [json.dumps({"summary": s, "evidence_indices": e, "suggested_checks": c, "uncertainty": u}) for s in ("a", "", 5) for e in ([], [1, "2", 3.5, True, -4], "1", None, {"a": 1}) for c in ([], ["a"], "a") for u in (None, "", "maybe")]
    df = spark.createDataFrame(list(enumerate(replies)), "k int, reply string").select("k", explanation.parsed(F.col("reply")).alias("e"))
    for r in df.collect():
        e, want = r["e"], brute(replies[r["k"]])
        got = e["error"] or (e["summary"], e["evidence_indices"], e["uncertainty"], e["suggested_checks"])
        assert got == want, replies[r["k"]]
    assert spark.createDataFrame([(None,)], "reply string").select(explanation.parsed(F.col("reply")).alias("e")).collect()[0]["e"]["error"] == explanation.NO_OBJECT
    assert v.EXPLANATION_LIMITS["indices"] == 6


def test_listing_stops_and_leaves_links_out(spark, tmp_path):
    tree, outside = tmp_path / "tree", tmp_path / "outside"
    for folder in (tree / "pkg", tree / "node_modules", outside):
        folder.mkdir(parents=True)
    (tree / "pkg/a.py").write_bytes(b"x = 1\n\xff\n")
    (tree / "pkg/big.py").write_text("y" * 5000)
    (tree / "node_modules/z.js").write_text("z")
    (tree / "yarn.lock").write_text("z")
    (outside / "secret.py").write_text("s")
    os.symlink(outside / "secret.py", tree / "escape.py")
    os.symlink(outside, tree / "folder")
    os.symlink(tree / "pkg/a.py", tree / "inner.py")
    got = {r["path"]: (r["language"], r["size_bytes"], r["line_count"], r["content"]) for r in src.discover(spark, str(tree), max_file_bytes=1000).collect()}
    assert got == {"pkg/a.py": ("Python", 8, 2, "x = 1\n�\n"), "pkg/big.py": ("Python", 5000, 0, None), "inner.py": ("Python", 8, 2, "x = 1\n�\n")}
    for name in ("pkg/a.py", "pkg/big.py"):
        os.chmod(tree / name, 0)  # nothing may be opened
    for limits in ({"max_files": 2}, {"max_bytes": 5000}):
        with pytest.raises(src.LimitExceeded):
            src.discover(spark, str(tree), **limits)
    (tmp_path / "none").mkdir()
    assert src.discover(spark, str(tmp_path / "none")).count() == 0
