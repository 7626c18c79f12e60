import random

import pytest

from pyspark.sql import functions as F

from codeloom.llm import counts, linedup, queries, store

from .conftest import ODD


def brute(rows):
    """(doc, n_lines, removed, n_links) by comparing all lines. Rows of one id are told apart by their text's hash; of equal rows
    the first keeps its lines."""
    texts = {(k, t or "") for k, t in rows}
    order = {x: i for i, x in enumerate(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, hash_of(x[1]))))}
    lines = [(x, i, frozenset(l.encode().split())) for x in order for i, l in enumerate(x[1].split("\n") if x[1] else [])]
    lines = [x for x in lines if x[2]]
    kinds = list({x[2] for x in lines})
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    links = {a: sum(similar(a, b) for b in kinds if b != a) for a in kinds}
    removed, n_links = {x: [] for x in order}, dict.fromkeys(order, 0)
    for j, (x, i, s) in enumerate(lines):
        n_links[x] += links[s]
        if any(similar(s, o) for _, _, o in lines[:j]):
            removed[x].append(i)
    out, seen = [], set()
    for k, t in rows:
        x = (k, t or "")
        gone = [i for y, i, _ in lines if y == x] if x in seen else removed[x]
        seen.add(x)
        out.append((k, len(x[1].split("\n")) if x[1] else 0, len(gone), n_links[x], gone))
    return sorted(out, key=str)


HASHES = {}


def hash_of(t):
    return HASHES[t]


def hashed(df):
    """Spark's hash of each text, which only orders texts of one id."""
    HASHES.update((r["t"], r["h"]) for r in df.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect())
    return df


def made(seed, n=80):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(500)]
    pool = []
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            if pool and rng.random() < 0.6:
                words = list(rng.choice(pool))
                for _ in range(rng.randint(0, max(1, len(words) // 8))):
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            else:
                words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            pool.append(words)
            lines.append(" ".join(words))
        rows.append((k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    df = hashed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, linedup.judged(df, 1 << (8 if seed == 1 else 16), 4 if seed == 1 else linedup.CHUNK).collect()), key=str) == brute(rows)
    if seed == 2:
        texts = {r["doc_id"]: r["text"] for r in linedup.deduplicated(df.withColumn("extra", linedup.F.lit(1))).collect()}
        for k, _, _, _, removed in brute(rows):
            assert texts[k] == "\n".join(l for i, l in enumerate(dict(rows)[k].split("\n")) if i not in removed)


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, linedup.judged(hashed(odd_docs)).collect()), key=str)
    assert got == brute([r[:2] for r in ODD])
    assert linedup.judged(no_docs).count() == 0


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in hashed(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert sorted(map(tuple, queries.op6_line_dedup(spark, sf).collect()), key=str) == brute(docs)


def test_rows_of_one_id_have_their_own_lines(spark):
    rows = [(0, "a b c d e"), (1, "a b c d e\nx y z"), (1, "q r s t u\nk l m n"), (1, "q r s t u\nk l m n")]
    df = hashed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, linedup.judged(df).collect()), key=str) == brute(rows)
    texts = sorted(r["text"] for r in linedup.deduplicated(df).collect())
    assert texts == sorted(["a b c d e", "x y z", "q r s t u\nk l m n", ""])


def test_names_of_other_columns_do_not_matter(spark):
    names = ["removed", "_id", "_hash", "n_links", "_removed", "word", "key", "SIZE"]
    df = spark.createDataFrame([(1, "a b c", *names), (2, "a b c\nd", *names)], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    got = sorted(linedup.deduplicated(df).collect())
    assert got == [(1, "a b c", *names), (2, "d", *names)]
    assert linedup.judged(df).count() == 2


def test_many_near_copies_of_one_line(spark):
    base = [f"w{i}" for i in range(30)]
    rows = [(k, " ".join([*base, f"x{k}", f"y{k % 7}"])) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_removed"], r["n_links"]) for r in linedup.judged(df, chunk=200).collect()}
    assert got == {k: (int(k > 0), 1499) for k, _ in rows}


def test_long_lines_with_words_in_common_are_settled_without_their_words(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{i}" for i in rng.sample(range(3000), 200))) for k in range(150)]
    rows.append((150, rows[0][1] + " w1 w2 w3"))
    tables, plain = {}, store.saved

    def saved(df, name, *more):
        tables[name] = plain(df, name, *more)
        return tables[name]

    monkeypatch.setattr(store, "saved", saved)
    df = hashed(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(map(tuple, linedup.judged(df).collect()), key=str) == brute(rows)
    n_keys = sum(len(r["keys"]) for r in tables["lines"].collect())
    assert n_keys > 5000 and 2 <= tables["line-promising"].count() < n_keys / 4  # by bits of whole lines, most stay


def test_large_blocks_that_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(counts, "BROADCAST_ROWS", 0)
    rows = made(1)
    df = hashed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, linedup.judged(df, 1 << 8, 4).collect()), key=str) == brute(rows)
