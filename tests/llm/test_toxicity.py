import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import queries, toxicity

ORDINARY = [a + b + c for a in ("the", "re", "on", "an", "st") for b in ("ing", "at", "or", "ea") for c in ("", "s", "ed", "ly")]
BAD = ["zurkheit", "zurkung", "zurkten", "vlobbig"]


def made(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(ORDINARY) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), 7))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_and_generalises_to_other_endings(spark):
    docs, labels = made(600)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, score int").drop("score"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    told = dict(labels)
    rows = toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string, score int"), model).collect()
    right = sum((r["score"] >= 0.5) == bool(told[r["doc_id"]]) for r in rows)
    assert right >= 0.97 * len(rows)
    new = [(1, "the ing ZURKABCD reatly onor"), (2, "the ing anors reatly onor"), (3, ""), (4, None), (5, "!!! 123"), (6, "anors " * 40000 + "zurkheit " * 4000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == got[5] < 0.5 and got[6] > 0.5


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (3, None), (None, 0)], [(1, 0), (1, 1)]])
def test_too_few_labels(spark, odd_docs, no_docs, labels):
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, told)
    rows = toxicity.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows) and "extra" in rows[0].asDict()
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, told)).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == t for p, t in held) >= 0.93 * len(held)


def test_words_are_scored_by_the_word_before(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(ORDINARY) for _ in range(20)]
        words[8:12] = ["vlob", "krin", rng.choice(ORDINARY), "krin"] if i % 4 == 0 else ["krin", "vlob", rng.choice(ORDINARY), "vlob"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = toxicity.scored(df, toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in rows)
    new = spark.createDataFrame([(0, "theat vlob krin onat"), (1, "theat krin vlob onat")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    ratios = {r["doc_id"]: r["score"] for r in toxicity.scored(new, model).collect()}
    assert ratios[0] > ratios[1]


def test_no_event_is_left_out_and_lower_orders_count_contexts():
    u = lambda *x: np.array(x, np.uint64)
    f = lambda *x: np.array(x, float)
    # word 7 follows three words once each, word 8 one word three times
    bigrams = (u(1, 2, 3, 4, 5), u(7, 7, 7, 8, 9), f(1, 1, 0, 3, 1), f(0, 0, 1, 1, 6))
    model = toxicity.fitted(bigrams, (u(1, 1), u(5, 6), f(1, 2), f(3, 1)), (u(0, 0, 0), u(7, 8, 9), f(2, 3, 1), f(1, 1, 6)))
    assert len(model.pairs.key) == 5 and len(model.words.key) == 3 and len(model.spelled.key) == 2
    assert all(model.words.value != 0) and all(model.spelled.value != 0)
    # doubling the documents of a pair changes no count of contexts
    estimates = [toxicity._level(np.zeros(3), f(2, 1, 1), f(1, 1, 1), [np.full(3, 0.25)] * 3, docs)[2] for docs in ((f(2, 3, 1), f(1, 1, 6)), (f(2, 6, 1), f(1, 2, 6)))]
    assert np.allclose(*estimates)


def brute_level(rows, lower, told=None):
    """rows: {(context, event): (toxic, ordinary)}, lower: {(context, event): estimates one order down} -> estimates in both and in common."""
    told = told or rows
    contexts = {c for c, _ in rows}
    count = lambda k, c: sum((t, o, t + o)[k] for (d, _), (t, o) in rows.items() if d == c)
    kinds = lambda k, c: sum((t, o, t + o)[k] > 0 for (d, _), (t, o) in rows.items() if d == c)
    total, types = {(k, c): count(k, c) for k in range(3) for c in contexts}, {(k, c): kinds(k, c) for k in range(3) for c in contexts}
    docs = {(k, c): sum(v[k] for (d, _), v in told.items() if d == c) for k in range(2) for c in contexts}
    evidence = {}
    for (c, e), (t, o) in told.items():
        a, b = docs[0, c] * lower[c, e][0], docs[1, c] * lower[c, e][1]
        p = min(max(a / (a + b), 1e-6), 1 - 1e-6)
        binomial = math.lgamma(t + o + 1) - math.lgamma(t + 1) - math.lgamma(o + 1) + t * math.log(p) + o * math.log(1 - p)
        evidence[c, e] = -math.log(t + o + 1) - binomial
    prior = 0.01
    for _ in range(30):
        own = {r: 1 / (1 + math.exp(-min(max(x + math.log(prior / (1 - prior)), -50), 50))) for r, x in evidence.items()}
        prior = min(max(sum(own.values()) / len(own), 1e-7), 0.5)
    out = {}
    for (c, e), (t, o) in rows.items():
        est = []
        for k, n in enumerate((t, o, t + o)):
            back = toxicity.DISCOUNT * types[k, c] / total[k, c] if total[k, c] else 1.0
            est.append(max(n - toxicity.DISCOUNT, 0) / max(total[k, c], 1) + back * lower[c, e][k])
        w = own[c, e] if docs[0, c] and docs[1, c] else 0.0
        out[c, e] = [w * est[k] + (1 - w) * est[2] * lower[c, e][k] / lower[c, e][2] for k in (0, 1)] + [est[2]]
    return out


def brute_pieces(word):
    before, out = None, []
    for n in (*toxicity.LENGTHS, None):
        piece = (n, word[:n], n is None or n >= len(word))
        out.append((before, piece))
        if piece[2]:
            return out
        before = piece
    return out


def brute_means(labelled, texts):
    """The mean log ratio of each text, by dictionaries."""
    split = lambda t: re.findall("[a-z]+", (t or "").lower())
    bigrams, singles, spelling = {}, {}, {}
    for toxic, t in labelled:
        words = split(t)
        found = [(bigrams, set(zip([None, *words], words, strict=False))), (singles, {(0, w) for w in words}), (spelling, {p for w in words for p in brute_pieces(w)})]
        for table, rows in found:
            for r in rows:
                seen = table.setdefault(r, [0, 0])
                seen[1 - toxic] += 1
    contexts = {(0, w): tuple(sum(v[k] > 0 for (_, x), v in bigrams.items() if x == w) for k in (0, 1)) for _, w in singles}
    single = brute_level(contexts, dict.fromkeys(singles, [1 / (len(singles) + 1)] * 3), singles)
    double = brute_level(bigrams, {r: single[0, r[1]] for r in bigrams})
    spelled = brute_level(spelling, dict.fromkeys(spelling, [1 / (len(spelling) + 1)] * 3))
    ratio = lambda e: math.log(e[0] / e[1])
    out = []
    for t in texts:
        words, total = split(t), 0.0
        for u, w in zip([None, *words], words, strict=False):
            if (u, w) in double:
                total += ratio(double[u, w])
            elif (0, w) in single:
                total += ratio(single[0, w])
            else:
                total += sum(ratio(spelled[p]) for p in brute_pieces(w) if p in spelled)
        out.append(total / max(len(words), 1))
    return out


def test_model_equals_dictionaries(spark):
    docs, labels = made(160, seed=4)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(toxicity.CALIBRATION))
    told = dict(labels)
    labelled = [(told[r["doc_id"]], r["text"]) for r in df.where(part != 0).collect()]
    assert 0 < sum(t for t, _ in labelled) < len(labelled) < len(docs)
    texts = [*(t for _, t, _ in docs), "", None, "ZURKHEITS, onor thee; anedlyzzzz zurkabcdefghij", "qqq the the"]
    want = brute_means(labelled, texts)
    assert np.allclose(model.means(pa.array(texts)), want, rtol=1e-3, atol=1e-5)
    assert max(want) > 0.1 > 0 > min(want)


def test_toxic_held_out_rows_are_found(spark):
    """Recall and false alarms, each by itself: a scorer that calls nothing toxic fails."""
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    rows = [r for r in queries.op3_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in toxic]
    bad = [r["predicted"] for r in rows if toxic[r["doc_id"]]]
    clean = [r["predicted"] for r in rows if not toxic[r["doc_id"]]]
    assert len(bad) > 50 and sum(bad) >= 0.85 * len(bad) and sum(clean) <= 0.02 * len(clean)
