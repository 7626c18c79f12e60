import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeloom.llm import binary, counts, queries, store

from .conftest import ODD

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a b", "a  b", "a\n b", "\na", "a\n", "don't stop 12 ab1!", "x <|endoftext|> y<|endoftext|>", "é漢   z", "A\r\nB c,d e\tf", "▁ a ▁b", "\0 a"]


def same_as_library(encoder, pieces, texts):
    column = pa.array(texts, pa.string())
    ids, n = encoder.encode(column)
    want = [e.ids for e in encoder.model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    ended, n = encoder.encode(column, [2])
    assert ended.tolist() == [i for x in want for i in [*x, 2]] and n.tolist() == [len(x) + 1 for x in want]
    assert pieces.count(column).tolist() == [len(x) for x in pieces.model.encode([t or "" for t in texts])]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1], [], [None, ""]])
def test_words_encode_as_whole_texts(texts):
    same_as_library(binary.WordEncoder(BPE), counts.PieceCounter(PIECE), texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\tZé1.,▁\u3000\u2009\xa0\x85", max_size=20), max_size=8))
def test_any_text_encodes_by_word(texts):
    same_as_library(binary.encoder(BPE), counts.counter(PIECE), texts)


def test_memo_that_begins_afresh(monkeypatch):
    monkeypatch.setattr(binary, "MEMO_WORDS", 3)
    monkeypatch.setattr(counts, "MEMO_WORDS", 3)
    model, pieces = binary.WordEncoder(BPE), counts.PieceCounter(PIECE)
    for texts in (["a b c d e f"], ["g h i a b c"], ["k l m a b z", "a b g\nh"]):
        same_as_library(model, pieces, texts)


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_packing_round_trip(ranks):
    padded = np.array(ranks + [0] * (-len(ranks) % 4), np.uint32)
    control, data, lengths = binary.pack(padded)
    assert len(control) * 4 == len(padded) and lengths.sum() == len(data)
    assert binary.unpack(control, data).tolist() == padded.tolist()


def expected_ids(rows):
    model = Tokenizer.from_file(BPE)
    start, out = 0, []
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in ordered:
        ids = np.array(model.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_id_files(spark, odd_docs, no_docs):
    folder = store.new_path(spark, "t")
    binary.write_ids(odd_docs, BPE, folder)
    rows = binary.read_ids(spark, folder, checksum=True).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(expected_ids(ODD), key=key)
    ids = binary.read_ids(spark, folder).where("doc_id = 8").collect()[0]["ids"]
    assert np.frombuffer(ids, "<u4").tolist() == [*Tokenizer.from_file(BPE).encode("x").ids, 2]
    empty = store.new_path(spark, "t")
    binary.write_ids(no_docs, BPE, empty)
    assert binary.read_ids(spark, empty).count() == 0


def test_query_over_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op2_token_ids(spark, "/root/testdata/sf0.001").collect()))
    assert got == expected_ids(docs)
    model = counts.counter(PIECE).model
    want = sorted((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in docs)
    assert sorted(map(tuple, queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect())) == want


def test_counts_and_cache(spark, odd_docs, no_docs):
    cache = store.new_path(spark, "c")
    model = counts.counter(PIECE).model
    got = counts.count_tokens(odd_docs, PIECE, cache).select("doc_id", "n_bytes", "n_tokens").collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in ODD]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in ODD})
    again = counts.count_tokens(odd_docs, PIECE, cache)
    assert again.count() == len(ODD) and spark.read.parquet(cache).count() == stored.count()  # nothing was encoded anew
    assert counts.count_tokens(no_docs, PIECE).count() == 0
    by_json = counts.count_tokens(odd_docs, BPE, cache).where("doc_id = 8").collect()[0]["n_tokens"]
    assert by_json == 1 and spark.read.parquet(cache).select("version").distinct().count() == 2


def test_shards_are_files_in_ascending_order(spark, monkeypatch):
    monkeypatch.setattr(binary, "SHARD_TOKENS", 300)
    rows = [((k * 7919) % 1000 if k % 10 else None, f"text {k} of many words") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    folder = store.new_path(spark, "t")
    binary.write_ids(df, BPE, folder)
    written = spark.read.parquet(f"{folder}/tokens").selectExpr("input_file_name() AS f", "shard", "monotonically_increasing_id() AS at", "doc_id", "text_hash")
    files = {}
    for r in written.orderBy("f", "at").collect():
        files.setdefault((r["shard"], r["f"]), []).append((r["doc_id"] is not None, r["doc_id"] or 0, r["text_hash"]))
    assert len(files) == len({s for s, _ in files}) > 10
    every = [x for k in sorted(files) for x in files[k]]
    assert every == sorted(every) and len(every) == 1000


def test_counts_of_the_session_live_on(spark):
    spark.conf.set("codeloom.tokenCache", store.new_path(spark, "lasting"))
    try:
        sf = "/root/testdata/sf0.001"
        first = sorted(map(tuple, queries.op8_token_counts(spark, sf).collect()))
        n = spark.read.parquet(counts.cache_folder(spark)).count()
        assert sorted(map(tuple, queries.op8_token_counts(spark, sf).collect())) == first
        assert spark.read.parquet(counts.cache_folder(spark)).count() == n
    finally:
        spark.conf.unset("codeloom.tokenCache")
