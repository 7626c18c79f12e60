import math

import numpy as np
import pytest

from codeloom.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def brute(vectors):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64)
    x += 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = (fit - 1_000_000).astype(float)
    centred -= centred.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    rows = (x - 1_000_000).astype(float) - (fit - 1_000_000).mean(axis=0)
    return n, deviation, rows, values, vectors


def check(rows, ids, vectors, k=16):
    n, deviation, centred, values, directions = brute(vectors)
    k = min(k, len(values), int((values > values[0] * 1e-11).sum()))
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(ids) and len(rows) == k * len(ids)
    want = centred @ directions[:, :k] / np.sqrt(values[:k])
    made = np.array([[got[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((want * made).sum(axis=0))
    assert np.abs(made - want * signs).max() < 1e-7
    for i, d in zip(ids, deviation):
        assert got[i][1]["n"] == n and got[i][1]["deviation"] == d
    assert [got[ids[0]][c + 1]["explained"] for c in range(k)] == pytest.approx(list(values[:k] / values.sum()), rel=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in rows)


def test_whole_table(spark):
    table = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, SF).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_many_dimensions_restart(spark, monkeypatch):
    """More dimensions than directions are kept: the basis starts again with the best."""
    monkeypatch.setattr(whitening, "BLOCK", 8)
    monkeypatch.setattr(whitening, "BASIS", 32)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((300, 90)) * np.geomspace(8, 0.5, 90)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(df, k=6)
    _, _, _, values, directions = brute(vectors)
    assert model.passes > 4 and model.values == pytest.approx(values[:6], rel=1e-11)
    assert np.abs(np.abs((model.vectors * directions[:, :6]).sum(axis=0)) - 1).max() < 1e-10
    assert (model.residuals <= 1e-12 * values[0]).all()


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (3, [-3.25, 0.0, 7.0]), (4, [2.0, 2.0, -1e3]), (5, [0.1, 0.2, 0.3]), (6, [40.0, -2.0, 1.0])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [math.nan, 1.0, 1.0]), (10, [math.inf, 1.0, 1.0]), (11, [1.0, 2.0]), (12, [])]
    schema = "vec_id long, embedding array<double>, x string, deviation string"
    df = spark.createDataFrame([(i, v, "e", "f") for i, v in good + bad], schema)
    model = whitening.fit(df)
    rows = whitening.whitened(df, model).collect()
    n, deviation, centred, values, directions = brute([v for _, v in good])
    assert model.n == n == 5 and sorted(r["vec_id"] for r in rows) == [i for i, _ in good]
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: d for (i, _), d in zip(good, deviation)}
    assert model.values == pytest.approx(values, rel=1e-9)
    # null ids and repeated rows stay; values beyond all bounds do not break it
    wild = spark.createDataFrame([(None, [1e300, 0.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1e300, 5.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(wild, whitening.fit(wild)).count() == 4
    # one distinct vector has no variance
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["whitened"] for r in whitening.whitened(same, whitening.fit(same)).collect()] == [[], []]


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whitening.whitened(df, whitening.fit(df)).count() == 0
