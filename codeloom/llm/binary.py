"""Token ids in a binary file format.

Ids are replaced by their rank of frequency over the whole corpus (ties: the lower id first), so that most ranks
fit one byte. Ranks are stored in 1 to 4 little-endian bytes; the byte lengths stand apart, two bits a rank, four
ranks a control byte. Decoding is a gather through tables: a control byte gives four lengths at once.

The files: ``<folder>/ranks`` (rank, id, n) and ``<folder>/tokens/shard=N`` with one row a document in ascending
``doc_id``: doc_id, text_hash, n_tokens, control, data. Shards hold ascending ranges, a file each, and grow in number with the
ids (``SHARD_TOKENS``); ``<folder>/shards`` (shard,
n_docs, n_tokens, first_start) tells how many ids precede each.

Cases: null and empty texts have the end id alone; documents of equal (or null) ``doc_id`` are ordered, and dealt to shards,
by their texts' hashes; a null ``doc_id`` comes first; equal rows are written each; very long texts are encoded whole; no
rows give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, text
from .memo import FEED, SPACE, START, Table, chunks_of, keyed
from .text import Words

END_ID = 2
MEMO_WORDS = 2_500_000  # words that a worker remembers, at about 30 bytes
SLICE_BYTES = 1 << 20
SHARD_TOKENS = 1 << 24  # of a shard, about
LINES = 4096
TOKENS = "doc_id long, text_hash long, n_tokens long, control binary, data binary"

_ENCODERS: dict[str, WordEncoder] = {}
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def _other_spaces(buf: np.ndarray) -> np.ndarray:
    """Where white space other than space and line feed stands (at its first byte)."""
    one, two = np.append(buf[1:], 0), np.append(buf[2:], [0, 0])[: len(buf)]
    out = ((buf >= 9) & (buf <= 13) & (buf != 10)) | ((buf >= 0x1C) & (buf <= 0x1F))
    out |= (buf == 0xC2) & ((one == 0x85) | (one == 0xA0))
    out |= (buf == 0xE1) & (one == 0x9A) & (two == 0x80)
    out |= (buf == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    out |= (buf == 0xE2) & (one == 0x81) & (two == 0x9F)
    return out | ((buf == 0xE3) & (one == 0x80) & (two == 0x80))


class WordEncoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    Its pre-tokenizer cuts before a single space or line feed that stands between two other characters, and never
    joins a line feed to what follows it, so words are encoded apart and remembered. Texts with other white space
    are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        with open(path) as f:
            stated = json.load(f)
        pre = stated.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not stated.get("normalizer")
        self.by_word = bool(self.by_word and not any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in stated["added_tokens"]))
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 65536 else "<u4")
        self.feed = self._ids(["\n"])[0]
        self.clear()

    def clear(self) -> None:
        self.table = Table(MEMO_WORDS, 2)
        self.pool, self.filled = np.zeros(1 << 16, self.kind), 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without white space but a leading space, end to end, and how many each has: many texts are
        encoded at a time, and a line feed's id tells where one ends."""
        flat, counts = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for at in range(0, len(lines), LINES):
            part = lines[at : at + LINES]
            ids = self._ids(["\n".join(part)])[0]
            cuts = np.flatnonzero(ids == self.feed[0]) if len(self.feed) == 1 else []
            if len(cuts) == len(part) - 1:
                flat.append(np.delete(ids, cuts))
                counts.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:
                each = self._ids(part)
                flat += each
                counts.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(counts).astype(np.int64)

    def _learn(self, words: Words, keys: np.ndarray, at: np.ndarray, kind: np.ndarray) -> None:
        """``at``: a word for each new key."""
        raw = words.buf.tobytes()
        for k in (START, SPACE, FEED):
            of = at[kind[at] == k]
            lead = " " if k == SPACE else ""
            flat, n = self._lines([lead + raw[a:b].decode() for a, b in zip(words.start[of].tolist(), words.end[of].tolist(), strict=True)])
            if k == FEED:
                flat = np.insert(flat, np.repeat(np.cumsum(n) - n, len(self.feed)), np.tile(self.feed, len(n)))
                n = n + len(self.feed)
            if self.filled + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + 2 * len(flat), self.kind)])
            self.pool[self.filled : self.filled + len(flat)] = flat
            self.table.add(keys[of], np.stack([self.filled + np.cumsum(n) - n, n], axis=1))
            self.filled += len(flat)

    def encode(self, column: pa.Array, end: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each followed by ``end``, and how many each text has."""
        n_docs = len(column)
        bad = _other_spaces(text.bytes_of(column)[0]) if self.by_word else None
        words, kind, hashes, irregular = chunks_of(column, bad)
        if not self.by_word:
            irregular = np.diff(words.doc_byte) > 0
            words.start, words.doc, kind, hashes = words.start[:0], words.doc[:0], kind[:0], hashes[:0]
        keys = keyed(hashes, kind)
        some, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.table) + len(some) > MEMO_WORDS:
            self.clear()
        rows, hit = self.table.find(some)
        if not hit.all():
            self._learn(words, keys, first[~hit], kind)
            rows, _ = self.table.find(some)
        lead, n = rows[back, 0], rows[back, 1]
        # whole texts and ends stand behind the words of their document
        whole = np.flatnonzero(irregular)
        raw = words.buf.tobytes()
        apart = [*self._ids([raw[words.doc_byte[d] : words.doc_byte[d + 1]].decode() for d in whole.tolist()]), np.array(end or [], self.kind)]
        sizes = np.array([len(x) for x in apart])
        places = self.filled + np.cumsum(sizes) - sizes
        pool = np.concatenate([self.pool[: self.filled], *apart])
        doc = np.concatenate([words.doc, whole, np.arange(n_docs)])
        order = np.argsort(doc, kind="stable")
        lead = np.concatenate([lead, places[:-1], np.full(n_docs, places[-1])])[order]
        n = np.concatenate([n, sizes[:-1], np.full(n_docs, sizes[-1])])[order]
        ids = pool[np.repeat(lead - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.bincount(doc[order], n, n_docs).astype(np.int64)


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks (as many as a multiple of four) -> control bytes, data bytes, bytes of each rank."""
    ranks = ranks.astype("<u4")
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = (n - 1).astype(np.uint8).reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]], n


def unpack(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks of ``pack``."""
    n = _LENGTHS[control].reshape(-1)
    out = np.zeros((len(n), 4), np.uint8)
    out[np.arange(4) < n[:, None]] = data
    return out.view("<u4").reshape(-1)


def _binaries(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def _sections(columns: list[pa.Array], item: str) -> list[np.ndarray]:
    return [np.frombuffer(text.bytes_of(c)[0].tobytes(), item) for c in columns]


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, text_hash, n_tokens, ids (little-endian; 2 bytes an id if the vocabulary allows)."""
    kind = encoder(tokenizer).kind
    whole = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, budget=SLICE_BYTES):
            ids, n = encoder(tokenizer).encode(piece.column(1), [end_id])
            narrow = _binaries(ids.view(np.uint8), np.cumsum(n) * kind.itemsize)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(n), narrow], ["doc_id", "text_hash", "n_tokens", "ids"])

    return whole.mapInArrow(encode, "doc_id long, text_hash long, n_tokens long, ids binary").withColumn("id_bytes", F.lit(kind.itemsize))


def frequencies(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs. The result is as long as the vocabulary, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for piece in text.slices(batches, "ids", SLICE_BYTES):
            kind = f"<u{piece.column(1)[0].as_py()}"
            total += np.bincount(_sections([piece.column(0)], kind)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for id_, n in encoded.select("ids", "id_bytes").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[id_] = n
    return out


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write the files described above to ``folder``."""
    spark = docs.sparkSession
    encoded = store.saved(encode_ids(docs, tokenizer, end_id), "ids")
    store.release(spark)
    counts = frequencies(encoded, max(encoder(tokenizer).model.get_vocab_size(), end_id + 1))
    id_of = np.lexsort((np.arange(len(counts)), -counts))
    rank_of = np.empty(len(counts), np.uint32)
    rank_of[id_of] = np.arange(len(counts), dtype=np.uint32)
    rows = pa.table({"rank": pa.array(np.arange(len(counts))), "id": pa.array(id_of), "n": pa.array(counts[id_of])})
    spark.createDataFrame(rows.to_pandas()).coalesce(1).write.parquet(f"{folder}/ranks")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, "ids", SLICE_BYTES):
            col = {n: piece.column(n) for n in piece.schema.names}
            ids = _sections([col["ids"]], f"<u{col['id_bytes'][0].as_py()}")[0]
            n = col["n_tokens"].to_numpy()
            padded = -(-n // 4) * 4
            at = np.arange(len(ids)) + np.repeat(np.cumsum(padded - n) - (padded - n), n)
            ranks = np.zeros(padded.sum(), np.uint32)
            ranks[at] = rank_of[ids]
            control, data, lengths = pack(ranks)
            ends = np.cumsum(padded)
            kept = [col["doc_id"], col["text_hash"], col["n_tokens"]]
            yield pa.RecordBatch.from_arrays([*kept, _binaries(control, ends // 4), _binaries(data, np.cumsum(lengths, dtype=np.int64)[ends - 1])], ["doc_id", "text_hash", "n_tokens", "control", "data"])

    packed = store.saved(encoded.mapInArrow(compress, TOKENS), "packed")
    store.delete(encoded)
    n_tokens = packed.agg(F.sum("n_tokens")).collect()[0][0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // SHARD_TOKENS))
    order = ["doc_id", "text_hash", "n_tokens"]
    dealt = packed.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id())
    dealt.sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(f"{folder}/tokens")
    store.delete(packed)
    totals = _tokens(spark, folder).groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    totals.withColumn("first_start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.parquet(f"{folder}/shards")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{TOKENS}, shard int").parquet(f"{folder}/tokens")


def read_ids(spark: SparkSession, folder: str, checksum: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (unsigned 32-bit little-endian), or their ids_crc32, from the files."""
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").toPandas()["id"]  # as long as the vocabulary
    id_of = ranks.to_numpy().astype("<u4")
    tokens, last = _tokens(spark, folder), "ids_crc32 long" if checksum else "ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, "data", SLICE_BYTES):
            col = {n: piece.column(n) for n in piece.schema.names}
            ids = id_of[unpack(text.bytes_of(col["control"])[0], text.bytes_of(col["data"])[0])]
            n = col["n_tokens"].to_numpy()
            lo = np.cumsum(-(-n // 4) * 4) - -(-n // 4) * 4
            cut = (ids[a : a + k].tobytes() for a, k in zip(lo.tolist(), n.tolist(), strict=True))
            out = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if checksum else pa.array(list(cut), pa.binary())
            yield pa.RecordBatch.from_arrays([col["shard"], col["doc_id"], col["text_hash"], col["n_tokens"], out], ["shard", "doc_id", "text_hash", "n_tokens", last.split()[0]])

    decoded = tokens.mapInArrow(decode, f"shard int, doc_id long, text_hash long, n_tokens long, {last}")
    earlier = Window.partitionBy("shard").orderBy("doc_id", "text_hash", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "first_start")
    within = decoded.withColumn("within", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return within.join(F.broadcast(shards), "shard").select("doc_id", (F.col("first_start") + F.col("within")).alias("start"), "n_tokens", last.split()[0])
