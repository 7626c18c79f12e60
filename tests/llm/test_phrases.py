import re
from collections import Counter

import duckdb
import pytest

from codeloom.llm import phrases, queries

SF = "/root/testdata/sf0.01"


def brute(rows, words=3, least=10, most=2000):
    """rows: (text, lang)."""
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    covered = set()
    for lang, p in out:
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inner = (lang, p[i : i + size])
                if 100 * f[lang, p] >= 50 * f[inner]:
                    covered.add(inner)
    result = []
    for lang in n:
        mine = sorted((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in out.items() if g == lang and (g, p) not in covered)
        result += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(mine[:most])]
    return sorted(result)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_whole_table_against_brute_force(spark):
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op13_collocations(spark, SF)) == brute(docs)


def test_sql_equivalent(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(phrases.ORACLE)
    names = [d[0] for d in want.description]
    assert got(queries.op13_collocations(spark, SF).select(*names)) == sorted(want.fetchall())


def test_a_full_sketch_loses_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert got(phrases.mined(docs, width=1 << 6, depth=1)) == brute(rows)


def test_four_words_and_other_thresholds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert got(phrases.mined(docs, words=4, least=5, most=70)) == brute(rows, 4, 5, 70)


def test_odd_rows(spark, odd_docs, no_docs):
    texts = [r["text"] for r in odd_docs.collect()]
    langs = [r["lang"] for r in odd_docs.collect()]
    assert got(phrases.mined(odd_docs, least=2)) == brute(list(zip(texts, langs)), least=2)
    assert phrases.mined(no_docs).count() == 0
    # ties are ordered by bytes; a null language joins und; extra columns may clash
    rows = [("ab é. ab é! Ab é, zz yy;zz yy\tzz\x0byy", None, "a", 1), ("ab é: zz yy", "und", "b", 2), ("\U0001f600 b \U0001f600 b | ￿ b | ￿ b", "en", "c", 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, phrase string, a int")
    assert got(phrases.mined(df, least=2)) == brute([r[:2] for r in rows], least=2)


@pytest.mark.parametrize("text", ["the cat " * 20000, "x", "a.b.c"])
def test_one_text(spark, text):
    df = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert got(phrases.mined(df)) == brute([(text, "en")])


def test_a_higher_score_of_a_lower_count_stays(spark):
    """Scores that share their thousand but not their order of counts: the best are cut by score, not by count."""
    rows = [(f"a{i} b{i}. " * (12 + i) + f"a{i} x. " * (200 if i == 0 else 2), "en") for i in range(40)]
    rows += [(f"c{i} d{i}. " * (400 + 3 * i) + f"c{i} y. " * (9 + i % 5 + 60) + f"z d{i}. " * 7, "en") for i in range(40)]
    rows += [(f"e{i} f{i}. " * (40 + i) + f"e{i} w. " * (i % 9), None) for i in range(60)]
    for most in (1, 7, 20, 45, 60, 300):
        assert got(phrases.mined(spark.createDataFrame(rows, "text string, lang string"), most=most)) == brute(rows, most=most)


def test_counts_of_one_range_of_scores(spark):
    rows = [("p q. " * 1000 + "p r. " + "s q. " * 1, "en"), ("g h. " * 5000 + "g i. " * 12, "en"), ("t u. " * 2000 + "t v. " * 4, "en")]
    for most in (1, 2):
        assert got(phrases.mined(spark.createDataFrame(rows, "text string, lang string"), most=most)) == brute(rows, most=most)
