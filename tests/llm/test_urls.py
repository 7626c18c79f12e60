import os

import duckdb
import pytest

from codeloom.llm import queries, urls


def duck(sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def test_sql_equivalent(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        df = queries.op1_url_filters(spark, sf)
        con = duck(sf).execute(urls.ORACLE)
        names = [d[0] for d in con.description]
        want = sorted(con.fetchall(), key=str)
        assert sorted(map(tuple, df.select(*names).collect()), key=str) == want
        assert {r[names.index("verdict")] for r in want if r[names.index("rule")] is None} <= {"allow", "block"}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.EXAMPLE.com/en/1?q#f", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.com", "x.com", "", None, "allow"),
        ("https://x.com/", "x.com", "/", "com/", "allow"),
        ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("ftp://net/es/a", "net", "/es/a", "net/es/", "block"),
        ("http://a.net/fr?x=/fr/", "a.net", "/fr", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://É.Net/ES/", "É.net", "/ES/", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = urls.judged(spark.createDataFrame([(1, url, 5)], "page_id long, url string, host int"), labels).collect()
    assert [tuple(r)[:5] for r in got] == [(1, host, path, rule, verdict)]


def test_templates_generalise_labels(spark):
    pages, labels = [], []
    for i in range(200):
        bad = i % 2
        pages.append((i, f"http://h.org/{'spam' if bad else 'news'}/{'x' * (i % 7)}{i}a/{i}"))
        if i < 60:
            labels.append((i, bad))
    pages += [(1000, None), (None, "http://h.org/spam/q/9"), (3, pages[3][1])]
    labels += [(3, None), (None, 1), (4, 1), (4, 0), (4, 0)]
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert len(got) == len(pages)
    verdicts = {(r["path"].split("/")[1], r["verdict"]) for r in got if r["path"]}
    assert verdicts == {("spam", "block"), ("news", "allow")}
    assert {r["template"] for r in got if r["path"].startswith("/spam/xx")} == {"/spam/<*>/<n>"}


def test_no_python_in_the_plan(spark):
    plan = queries.op1_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged(empty, spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_a_bad_section_among_many_is_kept_apart(spark):
    """A rare segment with labels of its own doesn't vanish in a wildcard, and variable segments above pool what is below them."""
    pages, labels = [], []
    for i in range(1200):
        section = i % 12
        pages.append((i, f"http://h.org/user{i % 50}/{'casino' if section == 0 else f's{section}'}/x{i}z"))
        if i % 3 == 0 or section == 0:
            labels.append((i, int(section == 0)))
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {(r["path"].split("/")[2] == "casino", r["verdict"]) for r in got} == {(True, "block"), (False, "allow")}
    assert {r["template"] for r in got if "casino" in r["path"]} == {"/<*>/casino/<*>"}


def test_very_long_urls(spark):
    long = "http://h.org/" + "/".join(f"p{k}" for k in range(8000))
    got = urls.judged(spark.createDataFrame([(1, long), (2, long + "/x")], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).collect()
    assert {r["template"] for r in got} == {long[12:], long[12:] + "/x"} and all(len(r["path"]) > 40_000 for r in got)


def verdicts(spark, pages, labels):
    return urls.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()


def test_labels_that_differ_deep_down(spark):
    pages = [(i, f"http://h.org/d0/d1/d2/d3/d4/d5/{'spam' if i % 2 else 'news'}/x{i}z") for i in range(400)]
    got = verdicts(spark, pages, [(i, i % 2) for i in range(200)])
    assert {(r["path"].split("/")[7], r["verdict"]) for r in got} == {("spam", "block"), ("news", "allow")}
    assert {r["template"] for r in got} == {"/d0/d1/d2/d3/d4/d5/spam/<*>", "/d0/d1/d2/d3/d4/d5/news/<*>"}


def test_sections_with_few_labels_join_their_like(spark):
    pages = [(i, f"http://h.org/s{i % 30}/x{i}z") for i in range(360)]
    got = verdicts(spark, pages, [(i, int(i % 30 < 15)) for i in range(90)])
    assert {(int(r["path"].split("/")[1][1:]) < 15, r["verdict"]) for r in got} == {(True, "block"), (False, "allow")}


def test_labels_by_chance_part_no_sections(spark):
    """One label a section is no evidence that sections differ, whatever the labels; a chain of segments adds none."""
    pages = [(i, f"http://h.org/s{i}/a/b/c/d/e/f/g") for i in range(100)]
    got = verdicts(spark, pages, [(i, int(i % 3 == 0)) for i in range(100)])
    assert {r["verdict"] for r in got} == {"allow"} and {r["template"] for r in got} == {"/<*>/a/b/c/d/e/f/g"}
    got = verdicts(spark, [(1, "http://h.org/a/b/c/d/e/f/g/h"), (2, "http://i.org/a")], [(1, 1), (2, 0)])
    assert {r["verdict"] for r in got} == {"allow"}


def test_sql_on_odd_trees(spark, tmp_path):
    """Random trees with ends at inner nodes, wildcards, marks as segments and skewed labels, by SQL level by level."""
    import random

    import pandas as pd

    draw = random.Random(5)
    words = ["~", "+3", "=a", "a", "", "7", "*", "<*>", *[f"k{j}" for j in range(12)]]
    pages, labels = [], []
    for i in range(3000):
        parts = [draw.choice(words) for _ in range(draw.choice([0, 1, 1, 2, 3, 4, 9]))]
        pages.append((i, draw.choice([f"http://{draw.choice('abc')}.org/{'/'.join(parts)}", f"http://d.org/x/y/z/{'/'.join(parts)}", f"http://e.org{'/'.join(parts)}?q", None])))
        if draw.random() < 0.7:
            bad = (parts[:1] in (["k1"], ["k2"], ["~"])) or parts[1:2] == ["a"]
            labels.append((i, int(bad != (draw.random() < 0.1))))
    pd.DataFrame(pages, columns=["page_id", "url"]).to_parquet(tmp_path / "pages.parquet")
    pd.DataFrame([(i, 1 - b) for i, b in labels], columns=["doc_id", "quality"]).to_parquet(tmp_path / "labels.parquet")
    con = duck(str(tmp_path)).execute(urls.ORACLE)
    names = [d[0] for d in con.description]
    want = sorted(con.fetchall(), key=str)
    got = queries.op1_url_filters(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want
    assert {r[names.index("verdict")] for r in want if r[names.index("rule")] is None} == {"allow", "block"}


def test_names_of_other_columns_do_not_matter(spark):
    names = ["host", "branch", "template", "typed", "n", "m", "bad"]
    df = spark.createDataFrame([(1, "http://a.com/x", *names)], ", ".join(["page_id long", "url string", *[f"{n} string" for n in names]]))
    assert [tuple(r)[:3] for r in urls.judged(df, spark.createDataFrame([(1, 1)], "page_id long, bad int")).collect()] == [(1, "a.com", "/x")]
