import random
from collections import Counter

import numpy as np
import pyarrow as pa

from codeloom.llm import bagminhash, components, neardup, queries, text

from .conftest import ODD


def bag(t):
    words = (t or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def partition(rows):
    """The classes by brute force: equal texts, and components of the pairs of similarity 0.8 or more."""
    texts = sorted({t or "" for _, t in rows})
    bags, up = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and similarity(bags[i], bags[j]) >= 0.8:
                up[root(i)] = root(j)
    of = {t: root(i) for i, t in enumerate(texts)}
    least = {}
    for k, t in rows:
        if k is not None:
            least[of[t or ""]] = min(k, least.get(of[t or ""], k))
    return sorted(((k, least.get(of[t or ""])) for k, t in rows), key=str)


def made(n, seed, edits=0.03):
    """Chains of edited copies: neighbours are close, distant ones are not."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts[-40:]).split()
            for _ in range(rng.randint(0, max(1, int(edits * len(words))))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))] * rng.choice([1, 1, 3])
        texts.append(" ".join(words))
        rows.append((i, texts[-1]))
    return rows


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    a = {int(k): int(n) for k, n in zip(rng.integers(0, 2**63, 300), rng.integers(1, 9, 300), strict=True)}
    b = {k: max(1, n + int(d)) for (k, n), d in zip(a.items(), rng.integers(-2, 3, 300), strict=True)}
    b = dict(list(b.items())[40:])
    want = sum(min(n, b.get(k, 0)) for k, n in a.items()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    doc = np.repeat([0, 1], [len(a), len(b)])
    value = np.array([*a, *b], np.uint64)
    weight = np.array([*a.values(), *b.values()])
    made_ = bagminhash.signatures(doc, value, weight, 2, registers=4096)
    assert abs((made_[0] == made_[1]).mean() - want) < 0.03
    one = bagminhash.signatures(doc[doc == 0], value[doc == 0], weight[doc == 0], 1, registers=4096)
    assert (one[0] == made_[0]).all()


def test_classes_equal_brute_force(spark):
    for few, chunk, seed in ((neardup.FEW, neardup.CHUNK, 1), (2, 5, 2)):
        rows = made(250, seed)
        got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), few, chunk).select("doc_id", "class_id").collect()
        assert sorted(map(tuple, got), key=str) == partition(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = neardup.classes(odd_docs).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == partition([r[:2] for r in ODD])
    assert neardup.classes(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[u] == got[v] for u, v in edges if u != v) and all(got[c] == c for c in got.values())
    assert {got[i] for i in range(61)} == {0}


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op4_near_dedup(spark, sf).collect()), key=str) == partition(docs)


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f a b c d e f", "a b", "", None, "x"]
    words = text.words_of(pa.array(texts))
    doc, value, n = text.counted(*text.shingles(words, words.hashes()))
    assert [Counter(n[doc == i].tolist()) for i in range(5)] == [Counter(bag(t).values()) for t in texts]


def test_pairs_across_components_are_verified():
    raw = b"one two three four five six seven"
    bag_ = len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)
    own = np.arange(128, dtype="<u2").tobytes()
    rows = {"side": [0, 0, 0], "node": [5, 6, 7], "weight": [3, 3, 3], "component": [1, 2, 2], "bag": [bag_] * 3, "signature": [own] * 3}
    assert neardup._block_links(pa.table(rows)) == [(5, 6)]
    assert neardup._block_links(pa.table(rows | {"component": [1, 1, 1]})) == []
    assert neardup._block_links(pa.table(rows | {"side": [0, 1, 0]})) == [(6, 5)]
    other = (np.arange(128, dtype="<u2") + 1000).tobytes()
    assert neardup._block_links(pa.table(rows | {"signature": [own, other, other]})) == []  # no band in common


def test_one_large_group(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base[: k % 50], f"x{k}", *base[k % 50 + 1 :]])) for k in range(700)] + [(1000 + k, "the same text in all of these rows") for k in range(1200)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), chunk=100).collect()}
    assert got == dict(partition(rows[:700])) | {1000 + k: 1000 for k in range(1200)}


def test_names_of_other_columns_do_not_matter(spark):
    names = ["kept_id", "kept_digest", "_id", "_digest", "node"]
    df = spark.createDataFrame([(1, "a b c d e f", *names), (2, "a b c d e f", *names)], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    assert neardup.kept(df).collect() == [(1, "a b c d e f", *names)]
