import re
from collections import Counter

import corpus_pipeline
from codeloom.llm import mixing

from .conftest import ODD
from .test_neardup import partition
from .test_tokens import expected_ids


def test_emitted_rows(spark, odd_docs, no_docs):
    rows = mixing.emitted(odd_docs)
    assert rows.columns == odd_docs.columns and mixing.emitted(no_docs).count() == 0
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in rows.collect())
    want = Counter()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in mixing.mixed(mixing.measured(odd_docs)).collect():
        text, source = next((o[1], o[3]) for o in ODD if o[0] == r["doc_id"] and size(o[1]) == r["size"] and ("s" + o[3] if o[3] else "n") == r["source_key"])
        want[r["doc_id"], text, source] += r["copies"]
    assert got == +want


def test_stages_on_a_whole_table(spark):
    """Each stage on its own input, against brute force."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    kept = stage["near_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    classes = dict(partition(rows(docs)))
    assert {k for k, _ in rows(kept)} == set(classes.values())
    assert {k for k, _ in rows(stage["toxicity"](spark, docs, sf))} < {k for k, _ in rows(docs)}
    mixed = stage["mixing"](spark, kept, sf)
    assert mixed.columns == docs.columns and max(Counter(rows(mixed)).values()) <= 3
    final = corpus_pipeline.run(spark, sf).collect()
    sources = {r["doc_id"]: r for r in docs.collect()}
    assert {r["doc_id"] for r in final} <= set(classes.values())
    want = expected_ids([(r["doc_id"], sources[r["doc_id"]]["text"]) for r in final])
    assert sorted(map(tuple, final)) == sorted(want)


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, sf)
        assert name == "token_ids" or got.columns == corpus_pipeline.COLUMNS
        rows = got.collect()
        if name == "near_dedup":  # one of the three equal texts, one of the two without words
            assert len(rows) == len({r[1] or "" for r in ODD})
        if name == "decontamination":
            assert len(rows) == len(ODD)
        if name == "token_ids":
            assert len(rows) == len(ODD) and min(r["n_tokens"] for r in rows) == 1
        assert stage(spark, no_docs, sf).count() == 0
