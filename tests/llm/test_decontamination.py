import random
import re

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import decontamination as d
from codeloom.llm import queries, text

VOCABULARY = [f"w{i}" for i in range(400)]


def corpus(seed, n_items=60, n_docs=60):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to"]
    make = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(VOCABULARY) for _ in range(n)]
    items = [(i, " ".join(make(rng.randint(6, 120)))) for i in range(n_items)]
    docs, planted = [], set()
    for i in range(n_docs):
        words = make(rng.randint(0, 300))
        if i % 3 == 0:
            item = rng.choice(items)
            at = rng.randint(0, len(words))
            words[at:at] = item[1].upper().split()
            planted.add((i, item[0]))
        docs.append((i, ", ".join(words)))
    return items, docs, planted


def index_of(items):
    """The index of (id, text) items by their own statistics."""
    table = pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items], "answer": pa.array([None] * len(items), pa.string())})
    of, _ = d._words_of([table["text"].combine_chunks(), table["answer"].combine_chunks()])
    terms, n = np.unique(np.concatenate([np.unique(x) for x in of]), return_counts=True)
    return d.built(table, len(items), sum(map(len, of)) / len(items), (terms, n))


def test_search_loses_nothing(monkeypatch):
    """What block-max WAND finds is what full scoring of each window finds."""
    for postings, batch in ((1, 100), (3, 1 << 16), (32, 3000)):
        monkeypatch.setattr(d, "POSTINGS", postings)
        monkeypatch.setattr(d, "BATCH", batch)
        items, docs, _ = corpus(4, 200)
        index = index_of(items)
        full = np.zeros((len(index.terms), len(items)))
        full[index.post_key >> 32, index.post_key & 0xFFFFFFFF] = index.impact
        words = text.words_of(pa.array([t for _, t in docs]), letters=True, digits=True)
        known = np.array([{h: i for i, h in enumerate(index.terms.tolist())}.get(h, -1) for h in words.hashes().tolist()])
        start, end, window, term = d._windows(words, known)
        got = {}
        for w, i, s in index.search(window, term):
            got.update(zip(zip(w.tolist(), i.tolist(), strict=True), s.tolist(), strict=True))
        want = {}
        for w, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            own = np.unique(known[a:b][known[a:b] >= 0])
            assert own.tolist() == term[window == w].tolist()
            scores = full[own].sum(axis=0)
            want.update({(w, int(i)): scores[i] for i in np.flatnonzero(scores >= d.NEARLY)})
        for common in (d.COMMON, 2):
            monkeypatch.setattr(d, "COMMON", common)
            can = index.reachable(window, term, len(start))
            assert {w for w, _ in want} <= set(np.flatnonzero(can).tolist()) and not can.all()
        assert want and set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)


def test_scores_do_not_depend_on_how_items_are_dealt(spark):
    items, docs, _ = corpus(11, 80, 40)
    items_df = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    one, many = (sorted(map(tuple, d.leaks(docs_df, items_df, size).collect())) for size in (d.INDEX_BYTES, 60_000))
    assert len(list(d.indexes(items_df, 60_000))) > 3
    assert [r[:3] for r in one] == [r[:3] for r in many] and np.allclose([r[3:] for r in one], [r[3:] for r in many], rtol=1e-5)


def test_one_index_at_a_time(spark):
    """However many indexes the items take, a plan holds one scan: what the ones before found is read from saved tables."""
    items, docs, _ = corpus(11, 80, 40)
    items_df = spark.createDataFrame(items, "item_id long, text string")
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    for made in (d.clean, d.leaks):
        for size in (d.INDEX_BYTES, 60_000):
            plan = made(docs_df, items_df, size)._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("MapInArrow") == 1
    left = {r["doc_id"] for r in d.clean(docs_df, items_df, 60_000).collect()}
    assert left == {r["doc_id"] for r in d.clean(docs_df, items_df).collect()} != {k for k, _ in docs}


def brute(items, docs):
    """Items of whose word 5-grams a document holds 0.8 or more."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    out = set()
    for k, t in docs:
        own = words(t)
        for i, it in items:
            w = words(it)
            n = min(5, len(w))
            grams = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)] if w else []
            have = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)}
            if grams and sum(g in have for g in grams) >= 0.8 * len(grams):
                out.add((k, i))
    return out


def test_planted_items_are_found_and_nothing_else(spark):
    items, docs, planted = corpus(7)
    items += [(900, ""), (901, None), (902, "w1 w2")]
    docs += [(100, None), (101, ""), (102, "x y"), (103, "w1, w2!")]
    for size in (d.INDEX_BYTES, 100_000):
        items_df = spark.createDataFrame(items, "item_id long, text string")
        docs_df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs_df, items_df, size).collect()}
        assert planted <= got == brute(items, docs)
        assert {r["doc_id"] for r in d.clean(docs_df, items_df, size).collect()} == {k for k, _ in docs} - {k for k, _ in got}


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "The cat sat on the mat and looked at the dog"), (2, "word word word"), (3, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in d.leaks(odd_docs, items).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (6, 2)]
    assert d.leaks(no_docs, items).count() == 0 and d.leaks(odd_docs, items.limit(0)).count() == 0
    assert d.clean(odd_docs, items).columns == odd_docs.columns and d.clean(odd_docs, items).count() == 6


def test_answer_column(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h", "i j k l m n o p")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l m n o p y"), (2, "a b c d e f g h")], "doc_id long, text string")
    assert [r["doc_id"] for r in d.leaks(docs, items).collect()] == [1]


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    items, docs = read("benchmark", "item_id"), read("documents", "doc_id")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, sf).collect()}
    fold = lambda rows: [(k, "".join(c if c.isalnum() else " " for c in t).replace("  ", " ")) for k, t in rows]
    ascii_ = lambda rows: [(k, t.encode("ascii", "xmlcharrefreplace").decode().replace("&#", "q")) for k, t in rows]
    assert got == brute(ascii_(fold(items)), ascii_(fold(docs)))
