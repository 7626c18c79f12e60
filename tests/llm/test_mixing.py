import re

import duckdb
import pytest

from codeloom.llm import mixing, queries

from .conftest import ODD


def filled(sizes, weights=(5, 2, 1), most=3):
    """Share the total by weight; stop at the caps and share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over, share = 0.0, left / total
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
        left = over
    return target


def check(rows, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in docs:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    want = filled(sizes)
    source_of = {r[0]: r[3] for r in docs}
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r[0]), words(r[1])) for r in docs)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["copies"] <= 3
        taken[s] += r["copies"] * r["size"]
    for s, n in taken.items():
        largest = max(words(r[1]) for r in docs if r[3] == s)
        assert abs(n - want[s]) <= 2 * largest + 1


def test_odd_rows(spark, odd_docs, no_docs):
    check(mixing.mixed(mixing.measured(odd_docs)).collect(), ODD)
    assert mixing.mixed(mixing.measured(no_docs)).count() == 0


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    first = queries.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    check(first, docs)
    assert sorted(first) == sorted(queries.op5_mixing(spark, "/root/testdata/sf0.01").collect())


def test_sql_equivalent(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(mixing.ORACLE)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.op5_mixing(spark, sf).select(*names).collect())) == sorted(want.fetchall())


def test_names_of_other_columns_do_not_matter(spark):
    names = ["mix_doc_id", "mix_size", "_doc_id", "_copies", "size", "copies"]
    df = spark.createDataFrame([(k, f"a b {k}", "s", *names) for k in range(4)], ", ".join(["doc_id long", "text string", "source string", *[f"{n} string" for n in names]]))
    rows = mixing.emitted(df).collect()
    assert rows and all(tuple(r)[3:] == tuple(names) for r in rows)
