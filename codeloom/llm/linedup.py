"""Line deduplication by an exact set-similarity join.

A line is the set of its words; lines whose Jaccard similarity is at least 0.8 match, and of matching lines the later
(by doc_id, text hash, line number) is removed. Lines of the same set are one class from the start. Words are ordered by
rarity: by how often they occur, counted over the whole corpus in ``SLOTS`` hash slots (any fixed order is right; a
slot shared by two words only makes them look less rare). A line needs its rarest size - ceil(0.8 size) + 1 words only:
two matching lines share one of these. A word that no other line holds joins nothing and is not sent.

A pair belongs to the first prefix word that both lines hold, so each is judged once and no pair is ever written. The
sets that share a prefix word are a block; blocks are judged twice. First without the words: the length filter, the
positional filter (words that can still be common), a parity filter (64 bits of the words after the shared one; each that
only one line holds flips one, and all words before it are such) and unequal preceding prefix words, all lossless, leave
the sets that may have a partner in the block. Here the sets of some thousand blocks go to the shuffle together, by
ranges of keys, many to a row. Then the words are read again, and the sets compared in numpy as they stream out of a sort;
each leaves the number of its links and its earliest partner. A block of more than ``CHUNK`` sets is cut into chunks, and
each two chunks are a block of their own, so no task holds a whole hot block; a set then goes to n / ``CHUNK`` of them.

Cases: null and empty texts have no lines to match; blank lines are never removed; a line of one to three words matches
only the same set; null ids come first; rows of equal doc_id are told apart by their text, and of equal rows all but
one lose all lines that are not blank; very long texts are taken whole, a slice at a time; no rows give no rows; extra
columns are ignored, whatever their names (``deduplicated`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import counts, store, text

SLOTS, SEGMENTS = 1 << 23, 64
SLICE_BYTES = 1 << 20
WORD_BYTES = 5
SEEN = 1 << 21  # sets that a task remembers
CHUNK = 1024  # sets of a block that are compared at once
PAIRS = 1 << 20  # pairs, and words of pairs, held at a time
ROWS = 1 << 17  # rows of blocks that are judged at a time
BUCKET = 1 << 16  # entries of a bucket, about
PACKED = 1 << 19  # entries that a task packs at once
ENTRY = np.dtype([("key", "<i4"), ("size", "<i4"), ("place", "<i4"), ("prev", "<i4"), ("set_hash", "<i8"), ("parity", "<i8")])
BLOCKS = "block long, info long, prev int, set_hash long, parity long"
MOST_CHUNKS = 1 << 16  # of a block; beyond, chunks are larger
HOT_LINES = 10_000  # a set of more lines is joined by broadcast: at most one in so many lines is such a set
_LOWEST = -(2**63)
_PLACED = ["set_hash", "doc_id", "text_hash", "line_number"]


def _breaks(buf: np.ndarray, doc_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By line: where it begins, its document, its number there."""
    breaks = np.unique(np.concatenate([doc_byte[:-1], np.flatnonzero(buf == 10) + 1]))
    breaks = breaks[breaks < max(len(buf), 1)]
    of = np.searchsorted(doc_byte, breaks, side="right") - 1
    first = np.searchsorted(of, np.arange(len(doc_byte) - 1))
    return breaks, of, np.arange(len(breaks)) - first[of]


def _distinct(line: np.ndarray, word: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, word, key, level of the key) of the distinct words of each line, by line and rarity."""
    key = _key(word)
    rare = level[key & (len(level) - 1)].astype(np.int64)
    at = line.astype(np.int64) << 39 | rare << 31 | key
    order = np.argsort(at)
    at, word = at[order], word[order]
    same = at[1:] == at[:-1]
    if (word[1:][same] != word[:-1][same]).any():  # two words of one key in a line
        order = np.lexsort((word, at))
        at, word = at[order], word[order]
        same = at[1:] == at[:-1]
    new = np.ones(len(at), bool)
    new[1:] = ~same | (word[1:] != word[:-1])
    at, word = at[new], word[new]
    return at >> 39, word, at & ((1 << 31) - 1), at >> 31 & 255


def _key(word: np.ndarray) -> np.ndarray:
    """31 bits of a word; blocks are of these."""
    return (text.mix(word ^ text._ODD[0]) >> np.uint64(33)).astype(np.int64)


def rarity(docs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """By slot: 0 and 1 for so many words, else 8 log2 of their number. ``slots`` bytes (a power of two), whatever the corpus."""

    def count(pieces: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(slots, np.uint32)
        for piece in text.slices(pieces, budget=SLICE_BYTES):
            np.add.at(total, _key(text.words_of(piece.column(0)).hashes()) & (slots - 1), np.uint32(1))
        return total

    def level(total: np.ndarray) -> np.ndarray:
        return np.where(total < 2, total, np.minimum(8 * np.log2(np.maximum(total, 2).astype(float)), 255)).astype(np.uint8)

    return store.merged_arrays(docs.select("text"), count, np.add, slots, "<u4", "<u8", SEGMENTS, level)


def _classes(line: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the set and size of each line."""
    size = np.bincount(line, minlength=n)
    total = np.zeros(n, np.uint64)
    if len(line):
        cuts = np.flatnonzero(np.diff(line, prepend=-1))
        total[line[cuts]] = np.add.reduceat(text.mix(word + text._ODD[1]), cuts)
    return text.mix(total + size.astype(np.uint64) * text._ODD[3]), size


def _bit(key: np.ndarray) -> np.ndarray:
    """The parity bit of a key, whether or not it is marked as one of large blocks."""
    return np.uint64(1) << (text.mix((key & ((1 << 31) - 1)).astype(np.uint64) ^ text._ODD[2]) & np.uint64(63))


def _prefix_size(size: np.ndarray) -> np.ndarray:
    return size - (-(-4 * size // 5)) + 1


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id and text, never null, and the text's hash."""
    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return known.withColumn("text_hash", F.xxhash64("text"))


def _repeated(docs: DataFrame) -> bool:
    return _identified(docs).groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def signed(known: DataFrame, level, chunk: int) -> DataFrame:
    """doc_id, text_hash, line_number, set_hash, size, parity (of the keys that other lines may hold), the keys of the prefix and the
    place of the first of all lines with words. A task gives the keys of a set once, and no keys with other lines of it.
    Keys of slots with more than ``chunk`` words are negative: only they can have large blocks."""
    hot = math.floor(8 * math.log2(chunk))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for piece in text.slices(batches, budget=SLICE_BYTES):
            words = text.words_of(piece.column(1))
            breaks, of, number = _breaks(words.buf, words.doc_byte)
            line, word, key, rare = _distinct(np.searchsorted(breaks, words.start, side="right") - 1, words.hashes(), level.value)
            set_hash, size = _classes(line, word, len(of))
            have = np.flatnonzero(size)
            some, first = np.unique(set_hash[have], return_index=True)
            new = ~np.isin(some, seen)
            fresh = np.zeros(len(of), bool)
            fresh[have[first[new]]] = True
            seen = some if len(seen) > SEEN else np.concatenate([seen, some[new]])
            held = size[have]
            begin = np.cumsum(held) - held
            place = np.arange(len(line)) - np.repeat(begin, held)
            shared = rare > 1
            shared[1:] &= (key[1:] != key[:-1]) | (line[1:] != line[:-1])
            bits = np.bitwise_xor.reduceat(np.where(shared, _bit(key), np.uint64(0)), begin) if len(have) else np.zeros(0, np.uint64)
            sent = shared & np.repeat(fresh[have] & (held >= 4), held)  # different sets of fewer words never match
            sent &= place < np.repeat(_prefix_size(held), held)
            own = np.where(rare >= hot, key - (1 << 31), key)[sent].astype(np.int32)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(line[sent], minlength=len(of))[have])), pa.int32())
            keys = pa.ListArray.from_arrays(offsets, pa.array(own, pa.int32()))
            skipped = np.zeros(len(of), np.int64)  # rarer words that no other line holds come first
            at = np.flatnonzero(sent)
            skipped[line[at[::-1]]] = place[at[::-1]]
            ids = [piece.column(k).take(pa.array(of[have])) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(number[have], pa.int32()), text.as_i64(set_hash[have]), pa.array(size[have], pa.int32()), text.as_i64(bits), keys, pa.array(skipped[have], pa.int32())], ["doc_id", "text_hash", "line_number", "set_hash", "size", "parity", "keys", "skipped"])

    return known.mapInArrow(sign, "doc_id long, text_hash long, line_number int, set_hash long, size int, parity long, keys array<int>, skipped int")


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """Of lines (set_hash, keys, size, parity, skipped): each key of the prefixes, its place, the key before it (``prev``) and the
    bits of the keys after it (``parity``)."""
    keys, size, parity, skipped = batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy()
    n, key = pc.list_value_length(keys).to_numpy().astype(np.int64), keys.flatten().to_numpy()
    begin, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(key)) - begin[row]
    seen = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(_bit(key.astype(np.int64)))])
    out = np.zeros(len(key), ENTRY)
    out["key"], out["size"], out["place"], out["set_hash"] = key, size[row], skipped[row] + nth, batch.column(0).to_numpy()[row]
    out["prev"][1:] = np.where(nth[1:] > 0, key[:-1], 0)
    out["parity"] = (parity ^ seen[begin])[row] ^ seen[1:]
    return out


def _columns(found: np.ndarray) -> pa.RecordBatch:
    """block, info, prev, set_hash, parity: ``block`` holds the key, ``info`` size and place."""
    block, info = found["key"].astype(np.int64) << 32, found["size"].astype(np.int64) << 32 | found["place"].astype(np.int64) << 1
    return pa.RecordBatch.from_arrays([pa.array(block), pa.array(info), *(pa.array(found[c]) for c in ("prev", "set_hash", "parity"))], ["block", "info", "prev", "set_hash", "parity"])


def _with_keys(rows: DataFrame) -> DataFrame:
    return rows.where("size(keys) > 0").select("set_hash", "keys", "size", "parity", "skipped")


def hot_entries(rows: DataFrame) -> DataFrame:
    """The entries of keys that can have large blocks, a row each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _entries(b)
            yield _columns(found[found["key"] < 0])

    return _with_keys(rows.where(F.exists("keys", lambda k: k < 0))).mapInArrow(each, BLOCKS)


def packed_entries(rows: DataFrame, buckets: int, apart) -> DataFrame:
    """bucket, entries: those of all keys but the ``apart`` (None: but the hot), many to a row. A bucket is a range of keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            whole = np.concatenate(held)
            held.clear()
            at = whole["key"].astype(np.int64) & ((1 << 31) - 1)
            order = np.argsort(at)
            whole, bucket = whole[order], at[order] * buckets >> 31
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            # byte by byte: the high bytes of keys, sizes and places are alike
            parts = [whole[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(parts, pa.binary())], ["bucket", "entries"])

        for b in batches:
            found = _entries(b)
            held.append(found[found["key"] >= 0 if apart is None else ~np.isin(found["key"], apart.value)])
            if sum(map(len, held)) >= PACKED:
                yield packed()
        if held:
            yield packed()

    return _with_keys(rows).mapInArrow(pack, "bucket int, entries binary")


def _unpacked(part: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(ENTRY.itemsize, -1).T).view(ENTRY).reshape(-1)


def _chunked(rows: DataFrame, large: DataFrame, only: bool) -> DataFrame:
    """The entries of the ``large`` blocks, of which ``block`` is a key and the two chunks whose sets it compares; ``info`` also
    holds which of the two chunks the set is in. Without ``only``: those of all hot keys."""
    own = F.pmod(F.xxhash64("set_hash", F.lit(3)), F.col("chunks")).cast("int")
    cut = counts.joined_by_size(hot_entries(rows), large, ["block"], "inner").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = F.col("block") + F.shiftleft(F.least("own", "other").cast("long"), 16) + F.greatest("own", "other")
    cut = cut.select(block.alias("block"), (F.col("info") + (F.col("own") > F.col("other")).cast("int")).alias("info"), "prev", "set_hash", "parity")
    return cut if only else cut.union(counts.joined_by_size(hot_entries(rows), large.select("block"), ["block"], "left_anti"))


@dataclass
class Entries:
    """The rows of whole blocks, by block and size: its running number, whether it compares one chunk with itself, and what each row has."""

    table: pa.Table
    block: np.ndarray
    inside: np.ndarray
    size: np.ndarray
    place: np.ndarray
    side: np.ndarray
    prev: np.ndarray
    parity: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Entries:
        block, info = table["block"].to_numpy(), table["info"].to_numpy()
        number = np.cumsum(np.diff(block, prepend=block[:1]) != 0)
        order = np.lexsort((table["set_hash"].to_numpy(), number << 32 | info >> 32))
        same = np.zeros(len(order), bool)  # a set comes once from each task that has it
        set_hash = table["set_hash"].to_numpy()[order]
        same[1:] = (set_hash[1:] == set_hash[:-1]) & (number[order][1:] == number[order][:-1])
        order = order[~same]
        block, info = block[order], info[order]
        prev, parity = table["prev"].to_numpy()[order], table["parity"].to_numpy()[order].view(np.uint64)
        return Entries(table.take(pa.array(order)), number[order], block & 0xFFFF == block >> 16 & 0xFFFF, info >> 32, info >> 1 & 0x7FFFFFFF, info & 1, prev, parity)

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where a pair passes the parity filter, the positional filter (from the shared word on) and has no common word just before.
        If the block's word is the first that both have, all words before it are of one line only, so fewer of those after it are."""
        both = self.size[a] + self.size[b]
        common = -(-4 * both // 9)
        apart = both - 2 * common - self.place[a] - self.place[b]  # at most so many words after the shared one are of one line only
        at = np.flatnonzero(np.bitwise_count(self.parity[a] ^ self.parity[b]).astype(np.int64) <= apart)
        a, b = a[at], b[at]
        keep = np.minimum(self.size[a] - self.place[a], self.size[b] - self.place[b]) >= common[at]
        return at[keep & ((self.prev[a] != self.prev[b]) | (self.prev[a] == 0))]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Entries]:
    """Whole blocks from a sorted stream, many small ones at a time."""
    held: list[pa.RecordBatch] = []
    n, least = 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held)
            block = table["block"].to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield Entries.of(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            n = table.num_rows - cut
            least = max(rows, 2 * n)
    if n:
        yield Entries.of(pa.Table.from_batches(held))


def _pairs(block: np.ndarray, size: np.ndarray, side: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (ascending by block, then size) of one block whose sizes allow a match, some at a time. ``inside``: whether
    the block compares one chunk with itself."""
    base = block.astype(np.int64) << 32
    end = np.searchsorted(base + size, base + 5 * size.astype(np.int64) // 4, side="right")
    n = np.maximum(end - np.arange(len(block)) - 1, 0)
    ahead = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ahead, ahead[at] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(at, to), n[at:to])
        right = np.arange(ahead[at], ahead[to]) - ahead[left] + left + 1
        keep = inside[left] | (side[left] != side[right])
        yield (left, right) if keep.all() else (left[keep], right[keep])
        at = to


def _streamed(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def promising(rows: DataFrame, n_entries: int, chunk: int) -> DataFrame:
    """The entries of blocks that may have a partner there which no earlier block has. Those of large blocks are cut into chunks and
    sorted as rows; all others come as buckets of whole blocks."""
    held = rows.select(F.explode("keys").alias("key")).where("key < 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = held.select("key", F.least(F.ceil(F.col("n") / chunk), F.lit(MOST_CHUNKS)).cast("int").alias("chunks")).where("chunks > 1")
    large = store.saved(large.select(F.shiftleft(F.col("key").cast("long"), 32).alias("block"), "chunks"), "line-large")
    n_large = large.limit(counts.BROADCAST_ROWS + 1).count()
    few = n_large <= counts.BROADCAST_ROWS
    apart = None
    if few:
        known = large.select(F.shiftright("block", 32).cast("int")).toArrow().column(0).to_numpy()
        apart = rows.sparkSession.sparkContext.broadcast(known.astype(np.int32))

    def judged(e: Entries) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(e.block), bool)
        for a, b in _pairs(e.block, e.size, e.side, e.inside):
            ok = e.possible(a, b)
            found[a[ok]] = True
            found[b[ok]] = True
        if found.any():
            yield from e.table.filter(pa.array(found)).combine_chunks().to_batches()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _blocks(batches, ROWS):
            yield from judged(e)

    def judge_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != last and sum(map(len, held)) >= ROWS:
                    yield from sorted_(held)
                last = bucket
                held.append(_unpacked(part.as_buffer()))
        if held:
            yield from sorted_(held)

    def sorted_(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate(held)
        held.clear()
        whole = whole[np.argsort(whole["key"])]
        yield from judged(Entries.of(pa.Table.from_batches([_columns(whole)])))

    buckets = max(1, n_entries // BUCKET)
    packed = packed_entries(rows, buckets, apart).repartition("bucket").sortWithinPartitions("bucket")
    out = packed.mapInArrow(judge_packed, BLOCKS)
    if few and not n_large:
        return out
    return out.union(_streamed(_chunked(rows, large, few)).mapInArrow(judge, BLOCKS))


def _narrow(word: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``WORD_BYTES`` bytes of a word: its key and 9 bits more. Two words of two lines that are compared have the same with a
    chance of one in 10 ** 12."""
    return ((word & np.uint64(0x1FF)) << np.uint64(31) | key.astype(np.uint64)).astype("<u8")


def _wide(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all lists end to end, and where each list begins."""
    raw, at = text.bytes_of(words)
    out = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = raw.reshape(-1, WORD_BYTES)
    return out.view("<u8").reshape(-1), at // WORD_BYTES


def _mark(doc_id: np.ndarray, text_hash: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of a line's place, for a sketch."""
    return text.mix(number.astype(np.uint64) * text._ODD[3] ^ text.mix(doc_id.view(np.uint64) + text.mix(text_hash.view(np.uint64))))


def words_of_sets(known: DataFrame, wanted: DataFrame, level, repeated: bool) -> DataFrame:
    """set_hash, doc_id, text_hash, line_number and words by rarity of the ``wanted`` sets (set_hash, first: doc_id, text_hash,
    line_number), read at the line given, and of a few others. A sketch tells which lines need not be read; the fuller it is, the
    more are, with the same results."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([text.as_i64(_mark(*(b.column(k).to_numpy() for k in range(3))))], ["h"])

    places = wanted.select("first.doc_id", "first.text_hash", "first.line_number").mapInArrow(hashed, "h long")
    sketch = known.sparkSession.sparkContext.broadcast(store.sketch(places))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, budget=SLICE_BYTES):
            buf, doc_byte = text.bytes_of(piece.column(1))
            breaks, of, number = _breaks(buf, doc_byte)
            ids, hashes = (piece.column(k).to_numpy() for k in (0, 2))
            asked = np.flatnonzero(store.marked(sketch.value, _mark(ids[of], hashes[of], number)))
            ends = np.append(breaks[1:], len(buf))[asked]
            n = ends - breaks[asked]
            chosen = buf[np.repeat(breaks[asked] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            words = text.words_of(pa.Array.from_buffers(pa.large_binary(), len(asked), [None, pa.py_buffer(np.append(0, np.cumsum(n)).astype(np.int64).tobytes()), pa.py_buffer(chosen.tobytes())]))
            line, word, key, _ = _distinct(words.doc, words.hashes(), level.value)
            set_hash, _ = _classes(line, word, len(asked))
            have, first = np.unique(line, return_index=True)
            narrow = _narrow(word, key).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
            lists = pa.Array.from_buffers(pa.binary(), len(have), [None, pa.py_buffer((np.append(first, len(line)) * WORD_BYTES).astype(np.int32).tobytes()), pa.py_buffer(narrow.tobytes())])
            own = asked[have]
            yield pa.RecordBatch.from_arrays([text.as_i64(set_hash[have]), pa.array(ids[of[own]]), pa.array(hashes[of[own]]), pa.array(number[own], pa.int32()), lists], [*_PLACED, "words"])

    found = store.saved(known.mapInArrow(collect, "set_hash long, doc_id long, text_hash long, line_number int, words binary"), "line-words")
    return found.dropDuplicates(_PLACED) if repeated else found


def _at(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    return text.mix(word + row.astype(np.uint64) * text._ODD[3])


class _Sets:
    """Word lists end to end."""

    def __init__(self, words: np.ndarray, start: np.ndarray) -> None:
        self.words, self.start, self.size = words, start, np.diff(start)

    def of_pairs(self, a: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The first ``n`` words of each of ``a``, some at a time: from, to, which of ``a``, word."""
        ahead = np.concatenate([[0], np.cumsum(n)])
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(ahead, ahead[at] + PAIRS, side="right")) - 1)
            pair = np.repeat(np.arange(at, to), n[at:to])
            yield at, to, pair, self.words[np.arange(ahead[at], ahead[to]) - ahead[pair] + self.start[a[pair]]]
            at = to

    def first_common(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where no key before the places of both is in both."""
        out = np.ones(len(a), bool)
        some = np.flatnonzero((place[a] > 0) & (place[b] > 0))
        for at, to, pair, word in self.of_pairs(a[some], place[a[some]]):
            key = np.uint64((1 << 31) - 1)
            mine = _at(pair, word & key)
            theirs = np.concatenate([_at(p + at, w & key) for _, _, p, w in self.of_pairs(b[some[at:to]], place[b[some[at:to]]])])
            out[some[pair[np.isin(mine, theirs)]]] = False
        return out

    def similar_in(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of similar sets in rows lo .. hi, which may be many, by adding up the lists of who holds each word."""
        m = hi - lo
        own = self.words[self.start[lo] : self.start[hi]]
        row = np.repeat(np.arange(m), self.size[lo:hi])
        _, word = np.unique(own, return_inverse=True)
        order = np.argsort(word, kind="stable")
        holders = row[order]
        n = np.bincount(word)
        first = np.cumsum(n) - n
        each = n[word]
        ahead = np.concatenate([[0], np.cumsum(each)])
        of_row = self.start[lo : hi + 1] - self.start[lo]
        at = 0
        while at < m:
            to = max(at + 1, min(at + max(1, 4 * PAIRS // m), int(np.searchsorted(ahead[of_row], ahead[of_row[at]] + 4 * PAIRS, side="right")) - 1))
            e = np.repeat(np.arange(of_row[at], of_row[to]), each[of_row[at] : of_row[to]])
            other = holders[first[word[e]] + np.arange(ahead[of_row[at]], ahead[of_row[to]]) - ahead[e]]
            common = np.bincount((row[e] - at) * m + other, minlength=(to - at) * m).reshape(to - at, m)
            a, b = np.nonzero(9 * common >= 4 * (self.size[lo + at : lo + to, None] + self.size[None, lo:hi]))
            keep = b > a + at
            yield a[keep] + at + lo, b[keep] + lo
            at = to


class _Some(_Sets):
    """Sets that are asked which words they hold."""

    def __init__(self, sets: _Sets, rows: np.ndarray) -> None:
        n = sets.size[rows]
        start = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(rows)), n)
        super().__init__(sets.words[np.arange(start[-1]) - start[row] + sets.start[rows][row]], start)
        self.held = np.sort(_at(row, self.words))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By pair: how many words both have."""
        out = np.zeros(len(a), np.int64)
        for at, to, pair, word in self.of_pairs(a, self.size[a]):
            asked = _at(b[pair], word)
            hit = self.held[np.minimum(np.searchsorted(self.held, asked), len(self.held) - 1)] == asked
            out[at:to] = np.bincount(pair[hit] - at, minlength=to - at)
        return out


def verified(promising_: DataFrame, words: DataFrame) -> DataFrame:
    """set_hash, n_links, earliest (doc_id, text_hash, line_number) of the sets with links."""
    rows = promising_.join(words, _PLACED)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in _blocks(batches, ROWS >> 4):
            n = len(e.block)
            sets = _Sets(*_wide(e.table["words"]))
            first = [e.table[c].to_numpy() for c in ("doc_id", "text_hash", "line_number")]
            by_rank = np.lexsort(first[::-1])
            rank = np.empty(n, np.int64)
            rank[by_rank] = np.arange(n)
            n_links, earliest = np.zeros(n, np.int64), np.full(n, n)
            edges = np.flatnonzero(np.diff(e.block, prepend=-1, append=e.block[-1] + 1))
            large = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 128]
            small = np.ones(n, bool)
            for a, b in large:
                small[a:b] = False
            small = np.flatnonzero(small)

            def pairs():
                if len(small):
                    some = _Some(sets, small)
                    for a, b in _pairs(e.block[small], e.size[small], e.side[small], e.inside[small]):
                        ok = e.possible(small[a], small[b])
                        a, b = a[ok], b[ok]
                        near = 9 * some.shared(a, b) >= 4 * (some.size[a] + some.size[b])
                        yield small[a[near]], small[b[near]]
                for lo, hi in large:
                    for a, b in sets.similar_in(lo, hi):
                        ok = (e.inside[a] | (e.side[a] != e.side[b])) & ((e.prev[a] != e.prev[b]) | (e.prev[a] == 0))
                        yield a[ok], b[ok]

            for a, b in pairs():
                own = sets.first_common(a, b, e.place)  # else an earlier block has the pair
                a, b = a[own], b[own]
                n_links += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                np.minimum.at(earliest, a, rank[b])
                np.minimum.at(earliest, b, rank[a])
            at = np.flatnonzero(n_links)
            if len(at):
                of = by_rank[earliest[at]]
                yield pa.RecordBatch.from_arrays([e.table["set_hash"].combine_chunks().take(pa.array(at)), pa.array(n_links[at]), *(pa.array(c[of]) for c in first[:2]), pa.array(first[2][of], pa.int32())], ["set_hash", "n_links", "doc_id", "text_hash", "line_number"])

    ordered = rows.select(*promising_.columns, "words")
    got = _streamed(ordered).mapInArrow(judge, "set_hash long, n_links long, doc_id long, text_hash long, line_number int")
    return got.groupBy("set_hash").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("doc_id", "text_hash", "line_number")).alias("earliest"))


def linked(docs: DataFrame, slots: int, chunk: int, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """(lines: doc_id, text_hash, line_number, set_hash), (set_hash, n (lines), n_links, earlier: the first of the set's lines and those
    of similar sets) of the sets of more than one line or with links."""
    spark, known = docs.sparkSession, _identified(docs)
    level = spark.sparkContext.broadcast(rarity(known, slots))
    counted = Observation()
    rows = store.saved(signed(known, level, chunk).observe(counted, F.sum(F.size("keys")).alias("n")), "lines")
    n_entries = counted.get["n"] or 0
    place = F.struct("doc_id", "text_hash", "line_number")
    sets = store.saved(rows.groupBy("set_hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "line-sets")
    store.release(spark)
    some = store.saved(promising(rows, n_entries, chunk), "line-promising")
    store.release(spark)
    wanted = store.sifted(sets.select("set_hash", "first"), some, ["set_hash"]).join(some.select("set_hash").distinct(), "set_hash", "left_semi")
    wanted = store.saved(wanted, "line-wanted")
    words = words_of_sets(known, wanted, level, repeated)
    some = some.join(wanted.select("set_hash", "first.*"), "set_hash")
    links = store.saved(verified(some, words), "line-links")
    store.release(spark)
    told = sets.where("n > 1").select("set_hash", "n", F.lit(0).cast("long").alias("n_links"), F.col("first").alias("earlier"))
    told = told.union(links.select("set_hash", F.lit(1).cast("long"), "n_links", "earliest"))
    told = told.groupBy("set_hash").agg(F.max("n").alias("n"), F.max("n_links").alias("n_links"), F.min("earlier").alias("earlier"))
    return rows.select("doc_id", "text_hash", "line_number", "set_hash"), told


def removals(docs: DataFrame, slots: int, chunk: int, repeated: bool) -> DataFrame:
    """doc_id, text_hash, removed (line numbers from 0, ascending), n_links (between the text's lines' sets and others), for texts with either."""
    lines, told = linked(docs, slots, chunk, repeated)
    told = store.saved(told, "line-told")
    lines = store.sifted(lines, told, ["set_hash"])
    many = told.where(F.col("n") > HOT_LINES)
    often = counts.joined_by_size(lines, many, ["set_hash"], "inner")
    seldom = counts.joined_by_size(lines, many.select("set_hash"), ["set_hash"], "left_anti").join(told.where(F.col("n") <= HOT_LINES), "set_hash")
    columns = ["doc_id", "text_hash", "line_number", "n_links", (F.col("earlier") < F.struct("doc_id", "text_hash", "line_number")).alias("removed")]
    placed = often.select(*columns).union(seldom.select(*columns))
    if repeated:  # a row repeated with its id has its lines twice
        placed = placed.distinct()
    gone = F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line_number")))).alias("removed")
    return placed.groupBy("doc_id", "text_hash").agg(gone, F.sum("n_links").alias("n_links")).where("size(removed) > 0 OR n_links > 0")


def _told(docs: DataFrame, rows: DataFrame, names: dict[str, str], slots: int, chunk: int) -> DataFrame:
    """``rows`` (with id, hash and, by line, the numbers of those that are not blank, under ``names``) with the lines to remove and
    the links of each row of ``docs``."""
    repeated = _repeated(docs)
    gone = store.saved(removals(docs, slots, chunk, repeated), "removals").select(*[F.col(a).alias(names[b]) for a, b in (("doc_id", "id"), ("text_hash", "hash"), ("removed", "removed"), ("n_links", "n_links"))])
    rows = rows.join(gone, [names["id"], names["hash"]], "left")
    none = F.array().cast("array<int>")
    removed = F.coalesce(names["removed"], none)
    if repeated:
        rows = rows.withColumn(names["nth"], F.row_number().over(Window.partitionBy(names["id"], names["hash"]).orderBy(F.lit(1))))
        removed = F.when(F.col(names["nth"]) == 1, removed).otherwise(F.coalesce(names["held"], none))
    return rows.withColumns({names["removed"]: removed, names["n_links"]: F.coalesce(names["n_links"], F.lit(0))})


def _named(docs: DataFrame) -> tuple[dict[str, str], dict]:
    names = store.fresh(docs, "id", "hash", "nth", "held", "removed", "n_links")
    held = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    return names, {names["id"]: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)), names["hash"]: F.xxhash64(F.coalesce("text", F.lit(""))), names["held"]: held}


def judged(docs: DataFrame, slots: int = SLOTS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, removed of every document."""
    docs = docs.select("doc_id", "text")
    names, made = _named(docs)
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)
    rows = _told(docs, docs.withColumns(made).withColumn("n_lines", n_lines).drop("text"), names, slots, chunk)
    removed = F.col(names["removed"])
    return rows.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), F.col(names["n_links"]).alias("n_links"), removed.alias("removed"))


def deduplicated(docs: DataFrame, slots: int = SLOTS, chunk: int = CHUNK) -> DataFrame:
    """``docs`` without the later matching lines of their texts."""
    names, made = _named(docs)
    rows = _told(docs, docs.withColumns(made), names, slots, chunk)
    removed = F.col(names["removed"])
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.when(F.array_contains(removed, i), None).otherwise(x)), lambda x: x.isNotNull())
    return rows.withColumn("text", F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns)
