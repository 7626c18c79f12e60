import hashlib
import random
from collections import Counter

import pytest

from codeloom.llm import queries, substrings
from codeloom.llm.suffixes import suffix_array

SF = "/root/testdata/sf0.01"


def brute(rows, window=100):
    """rows: (doc_id, text) -> the multiset of (doc_id, n_bytes, n_removed, n_spans, digest)."""
    seen, out = set(), Counter()
    for doc_id, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            else:
                seen.add(w)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(df):
    from pyspark.sql import functions as F

    rows = df.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.size("spans"), F.sha2("kept", 256)).collect()
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array(seed):
    r = random.Random(seed)
    for _ in range(300):
        s = [r.randint(1, r.choice([1, 2, 3, 26])) for _ in range(r.randint(0, 50))] * r.choice([1, 1, 3]) + [0]
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_whole_table_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs)
    assert Counter(map(tuple, queries.op12_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want
    assert any(k[2] for k in want)


def planted(seed):
    """Passages in changing contexts, periodic texts, copies with edits, two ends that overlap."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(k) for k in (30, 40, 60)]
    docs = []
    for k in range(60):
        base = [text(r.randint(0, 40)), r.choice(passages)[r.randint(0, 30) :], text(r.randint(0, 20)), r.choice(passages)]
        docs.append((k, " ".join(base)))
        if k % 7 == 0:
            cut = list(docs[-1][1])
            cut[len(cut) // 2] = "#"
            docs.append((100 + k, "".join(cut)))
    docs += [(200, "ab" * 500), (201, "ab" * 400 + "b"), (202, "a" * 3000), (203, "x" * 99), (204, "x" * 99), (205, "y" * 100), (206, "y" * 101)]
    return docs


@pytest.mark.parametrize("hot", [substrings.HOT, 4])
def test_planted_repeats(spark, monkeypatch, hot):
    """With ``hot`` at 4 nearly all keys are cut into windows."""
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = planted(hot)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(substrings.deduplicated(df)) == brute(docs)


def test_slices_and_arrays_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 500)
    monkeypatch.setattr(substrings, "ARRAY_BYTES", 300)
    docs = planted(3)
    assert got(substrings.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(substrings.deduplicated(odd_docs)) == brute(rows)
    assert substrings.deduplicated(no_docs).count() == 0
    long = "".join(random.Random(1).choice("abc d") for _ in range(400))
    other = long[100:300] + "!" + long[:150]
    # repeated rows, one id with two texts, null ids, clashing names
    rows = [(5, long), (5, long), (5, other), (None, long), (None, long), (None, other), (7, None), (7, None), ((1 << 63) - 1, long), (3, "short"), (3, "short")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, blob string, h long")
    found = got(substrings.deduplicated(df))
    assert sum(found.values()) == len(rows)
    by_size = lambda c: Counter({(k[0], k[1]): sum(n for x, n in c.items() if x[:2] == k[:2]) for k in c})
    assert by_size(found) == by_size(brute(rows))
    total = lambda c: sum(k[2] * n for k, n in c.items())
    assert total(found) == total(brute(rows))  # the order of texts of one id is free
