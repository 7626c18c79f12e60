import math
import random
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import katz, queries

from .conftest import ODD


def tokens(t):
    return [w.lower() for w in (t or "").encode().split()] + [None]


def brute(train, docs):
    """Katz backoff of order 3 over dictionaries."""
    counts = [Counter(), Counter(), Counter()]
    for t in train:
        own = tokens(t)
        v = ["start", *own[:-1]]
        u = ["start", *v[:-1]]
        counts[0].update(own)
        counts[1].update(zip(v, own, strict=True))
        counts[2].update(zip(u, v, own, strict=True))
    d = [katz.discounts([Counter(c.values())[r] for r in range(1, katz.TOP + 2)]) for c in counts]
    kept = [{k: c * (f[c] if c <= katz.TOP else 1.0) for k, c in count.items()} for f, count in zip(d, counts, strict=True)]
    n, v = sum(counts[0].values()), len(counts[0])
    raised = lambda total, rest: total + (rest >= total - 1e-9)
    word_total = raised(n, sum(kept[0].values())) if n else 1
    unknown = 1 - sum(kept[0].values()) / word_total

    def weights(order, lower):
        """By context: its count, and its backoff weight."""
        sums = {}
        for k, c in counts[order].items():
            s = sums.setdefault(k[:-1], [0, 0.0, 0.0])
            s[0] += c
            s[1] += kept[order][k]
            s[2] += lower(k[1:])
        return {h: (raised(c, k), (1 - k / raised(c, k)) / (1 - p)) for h, (c, k, p) in sums.items()}

    p1 = lambda k: kept[0][k[0]] / word_total if k[0] in kept[0] else unknown
    two = weights(1, p1)
    p2 = lambda k: kept[1][k] / two[k[:1]][0] if k in kept[1] else two.get(k[:1], (0, 1.0))[1] * p1(k[1:])
    three = weights(2, p2)
    p3 = lambda k: kept[2][k] / three[k[:2]][0] if k in kept[2] else three.get(k[:2], (0, 1.0))[1] * p2(k[1:])
    for h in list(three)[:20]:  # each context sums to one over the known types and the unknown one
        assert sum(p3((*h, w)) for w in counts[0]) + p3((*h, "unknown")) == pytest.approx(1)
    out = []
    for k, t in docs:
        own = tokens(t)
        before = ["start", *own[:-1]]
        grams = list(zip(["start", *before[:-1]], before, own, strict=True))
        base = sum(math.log10((counts[0][w] + 1) / (n + v + 1)) for w in own)
        out.append((k, len(own), sum(counts[0][w] > 0 for w in own), base, sum(math.log10(p3(g)) for g in grams)))
    return out, n


def same(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows), key=key)
    want = sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-9)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"W{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.randint(5, 60)]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    docs += [(1000, None), (1001, "new words only"), (None, "W1 W2"), (3, docs[3][1])]
    monkeypatch.setattr(katz, "SLICE_BYTES", 3000)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("extra", katz.F.lit(1))
    want, n = brute([t for k, t in docs if k is not None and k < 100], docs)
    for hot, part_tokens in ((20, 100), (katz.HOT, katz.PART_TOKENS), (0, 50)):
        model = katz.fit(df.where("doc_id < 100"), hot, part_tokens)
        assert model.train_tokens == n
        same(katz.scored(df, model).collect(), want)


def test_odd_rows(spark, odd_docs, no_docs):
    model = katz.fit(odd_docs)
    want, _ = brute([r[1] for r in ODD], [r[:2] for r in ODD])
    same(katz.scored(odd_docs, model).collect(), want)
    assert katz.scored(no_docs, model).count() == 0
    nothing = katz.fit(no_docs)
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in katz.scored(odd_docs, nothing).collect())


def test_query_improves_on_the_base(spark):
    rows = queries.op9_lm_score(spark, "/root/testdata/sf0.001").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_null_ids_are_not_learnt_and_no_table_is_left(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (None, "z z z z")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = {t.name for t in spark.catalog.listTables()}
    rows = queries.op9_lm_score(spark, str(tmp_path)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    kept = [r for r in rows if r["doc_id"] is not None and not r["held_out"]]
    assert len(rows) == 3 and kept and all(r["train_tokens"] == 4 * len(kept) for r in rows)
    assert [(r["n_known"], r["held_out"]) for r in rows if r["doc_id"] is None] == [(1, False)]
    model = katz.fit(docs)
    plan = model.trigrams.groupBy("part").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_all_trigrams_are_in_the_table(spark):
    docs = [(1, "a b c a b d e"), (2, "a b f")]
    model = katz.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    grams = Counter()
    for _, t in docs:
        v = ["start", *tokens(t)[:-1]]
        grams.update(zip(["start", *v[:-1]], v, tokens(t), strict=True))
    n = [katz.unpack(r["blob"], "<u8", "<u8", "<u8", "<i8")[3] for r in model.trigrams.collect()]
    assert sorted(np.concatenate(n)) == sorted(grams.values())
    d = katz.discounts([8, 3, 1, 1, 1, 1])
    assert 0 < d[1] < 1
