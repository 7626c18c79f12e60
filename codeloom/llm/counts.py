"""Token counts with a digest cache.

A text is keyed by the SHA-256 of its content (null is empty) and the digest of the tokenizer's file. Stored
counts are joined; each distinct text without one is encoded once and appended to the cache.

Cases: null and empty texts have 0 bytes and 0 tokens; equal texts share one entry; repeated or null ``doc_id``
are kept; very long texts are encoded whole; no rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, text
from .memo import FEED, SPACE, Table, chunks_of, keyed

LIMIT = 4096
MEMO_WORDS = 2_500_000  # words that a worker remembers, at about 16 bytes
BROADCAST_ROWS = 1_000_000  # keys of 8 to 32 bytes
CACHE = "content_digest binary, version string, n_tokens long"

_COUNTERS: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts of a sentencepiece model, word by word.

    Where no piece of the vocabulary crosses a space or a line feed, the pieces of a text are those of its words.
    Texts with runs of spaces, or with the model's own space mark, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any(mark in p.strip(mark) or "\n" in p or " " in p for p in pieces) and self.model.encode("a  b", out_type=str) != self.model.encode("a b", out_type=str)
        self.table = Table(MEMO_WORDS, 1)

    def count(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        buf, _ = text.bytes_of(column)
        mark = (buf == 0xE2) & (np.append(buf[1:], 0) == 0x96)[: len(buf)] & (np.append(buf[2:], [0, 0])[: len(buf)] == 0x81)
        words, kind, hashes, irregular = chunks_of(column, mark | (buf == 0) if self.by_word else np.ones(len(buf), bool))
        keys = keyed(hashes, np.where(kind == FEED, FEED, SPACE))  # the model puts its space mark before the first word too
        some, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.table) + len(some) > MEMO_WORDS:
            self.table.clear()
        rows, hit = self.table.find(some)
        if not hit.all():
            raw, at = words.buf.tobytes(), first[~hit]
            fed = kind[at] == FEED
            new = [("\n" if f else "") + raw[a:b].decode() for a, b, f in zip(words.start[at].tolist(), words.end[at].tolist(), fed.tolist(), strict=True)]
            # the space mark that the model puts before a line feed is a piece of its own
            n = np.array([len(x) for x in self.model.encode(new, num_threads=1)], np.int64) - fed
            self.table.add(some[~hit], n[:, None])
            rows[~hit, 0] = n
        out = np.bincount(words.doc, rows[back, 0], len(column)).astype(np.int64)
        raw = words.buf.tobytes()
        for d in np.flatnonzero(irregular).tolist():
            out[d] = len(self.model.encode(raw[words.doc_byte[d] : words.doc_byte[d + 1]].decode()))
        return out


class JsonCounter:
    """Counts of a ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, column: pa.Array) -> np.ndarray:
        texts = pc.fill_null(column, "").to_pylist()
        return np.array([len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)], np.int64)


def counter(path: str) -> PieceCounter | JsonCounter:
    """The counter of a tokenizer file, one a process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _COUNTERS[path]


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).where(F.col("version") == version).groupBy("content_digest", "version").agg(F.max("n_tokens").alias("n_tokens"))


def joined_by_size(big: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with ``keys`` broadcast if they are counted to be few, else by shuffle."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(keys) if few else keys, on, how)


def cache_folder(spark: SparkSession) -> str | None:
    """The folder of stored counts that the session names in ``codeloom.tokenCache``: it lives on between runs."""
    return spark.conf.get("codeloom.tokenCache", None)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None) -> DataFrame:
    """doc_id, content_digest, n_bytes, n_tokens of every document. ``cache``: folder of stored counts, added to (else that of the
    session, else a new one)."""
    spark = docs.sparkSession
    cache = cache or cache_folder(spark) or store.new_path(spark, "token-cache")
    version = version_of(tokenizer)
    content = F.coalesce("text", F.lit(""))
    lowest = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    whole = docs.select("doc_id", content.alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256))).withColumn("holder", lowest)
    keyed = store.saved(whole.select("doc_id", "holder", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    distinct = keyed.groupBy("content_digest").agg(F.min("holder").alias("holder"))
    misses = store.saved(distinct.join(read_cache(spark, cache, version), "content_digest", "left_anti"), "misses")
    mark = F.xxhash64("content_digest", "holder")
    asked = spark.sparkContext.broadcast(store.sketch(misses.select(mark.alias("h"))))
    texts = whole.select("content_digest", "text", "holder", mark.alias("h"))
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():  # rows repeated with their id: each text once
        texts = texts.join(misses, ["content_digest", "holder"], "left_semi").dropDuplicates(["content_digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(tokenizer)
        for piece in text.slices(batches, budget=1 << 20):
            piece = piece.filter(pa.array(store.marked(asked.value, piece.column(3).to_numpy())))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(model.count(piece.column(1)))], ["content_digest", "holder", "n_tokens"])

    found = texts.select("content_digest", "text", "holder", "h").mapInArrow(encode, "content_digest binary, holder long, n_tokens long")
    found = found.join(misses, ["content_digest", "holder"], "left_semi")  # what the sketch let pass besides
    found.select("content_digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    return keyed.drop("holder").join(read_cache(spark, cache, version).drop("version"), "content_digest")
