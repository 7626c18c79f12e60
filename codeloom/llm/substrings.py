"""Removal of repeated substrings: every byte goes that a string of ``WINDOW`` bytes covers which also starts earlier.

Texts are UTF-8 bytes. A window (a string of 100 bytes) is keyed by the least hash of the 50-byte strings inside it, so that equal
windows have equal keys, wherever they stand. A run of windows of one key is a segment. Then

1. keys are counted over all texts (five bytes each); those that occur once can hold no repeat and are left out by a sketch;
2. equal segments are merged, first within a slice of texts and then by key: all but the first are repeats as a whole;
3. keys that several different segments share, or one that repeats a window by itself, get a suffix array (see ``suffixes``), many keys
   in one: windows that share 100 bytes are neighbours there, and all but the first of them are repeats. Windows at the ends of a
   segment whose hash no other window of the key has are cut off before;
4. a document's repeats are merged to spans and cut out.

A key of very many segments (``HOT``: a passage that very many documents hold) is cut into its windows, each with a key of its own, so
that its groups stay small; equal ones are merged before they are sent. Order is that of doc_id, then of the text's hash.

Cases: a null text is an empty one; texts under 100 bytes stay whole; a null doc_id comes last; of rows that are equal in doc_id and
text the first is judged and the others, whose every window starts earlier, go whole; a long run of one key is cut into segments, so
a very long text makes no long string; no rows give no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts, store, text
from .suffixes import suffix_array

WINDOW, GRAM = 100, 50
WIDE = WINDOW - GRAM + 1  # strings of GRAM bytes in a window
HOT = 1 << 13  # segments of a key, at least, beyond which it is cut into windows
SLICE_BYTES = 2 << 20
ARRAY_BYTES = 1 << 15  # of a suffix array, about
SIEVED_BYTES = 1 << 22
KEYS_A_SHARD = 1 << 20
COUNT = np.dtype([("low", "<u4"), ("high", "u1"), ("n", "<u2")])
_ODD = np.uint64(0x9E3779B97F4A7C15)
LAST = (1 << 63) - 1
BLOBS = "shard long, blob binary"
MARKS = "id long, h long, start long, end long"
SEGMENT = np.dtype([("key", "<u8"), ("digest", "<u8"), ("id", "<i8"), ("h", "<i8"), ("start", "<i8"), ("n", "<i4"), ("inner", "u1")])


class Segments:
    """The segments of a slice of texts: key, digest, document, start and number of windows."""

    def __init__(self, column: pa.Array, hot: np.ndarray | None = None) -> None:
        self.buf, self.at = text.bytes_of(column)
        self.sums = text.Words(self.buf, self.at, *[np.zeros(0, np.int64)] * 4).prefix_sums()
        size = len(self.buf)
        if size < WINDOW:
            self.start = self.n = self.doc = np.zeros(0, np.int64)
            self.key = self.digest = np.zeros(0, np.uint64)
            self.single = self.inner = np.zeros(0, bool)
            return
        _, inverse = text._powers(size + 1)
        with np.errstate(over="ignore"):
            grams = (self.sums[GRAM:] - self.sums[:-GRAM]) * inverse[: size - GRAM + 1] * _ODD
        least = _window_min(grams, WIDE)
        first, last = self.at[:-1], self.at[1:] - WINDOW  # of windows, by document
        full = np.flatnonzero(last >= first)
        edge = np.zeros(size + 1, np.int8)
        edge[first[full]] += 1
        np.add.at(edge, last[full] + 1, -1)
        inside = np.cumsum(edge[: len(least)], dtype=np.int8) > 0
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        new[first[full]] = True
        run = np.flatnonzero(new)
        stop = np.flatnonzero(inside & np.append(~inside[1:] | new[1:], True)) + 1
        pieces = (stop - run + WIDE - 1) // WIDE  # long runs in pieces
        which = np.repeat(np.arange(len(run)), pieces)
        start = run[which] + (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WIDE
        n = np.minimum(stop[which] - start, WIDE)
        key, singles = text.mix(least[start]), 0
        # a segment whose least string enters again after its first window is the only kind that repeats a window by itself
        entered = np.flatnonzero(inside & ~new & (least == grams[WIDE - 1 : WIDE - 1 + len(least)]))
        of = np.searchsorted(start, entered, side="right") - 1
        inner = np.zeros(len(start), bool)
        inner[of[entered > start[of]]] = True
        if hot is not None and len(hot):
            often = np.isin(_short(key), hot)
            if often.any():  # each window by itself
                which, singles = np.repeat(np.flatnonzero(often), n[often]), int(n[often].sum())
                each = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[often]) - n[often], n[often])
                start, n = np.concatenate([start[~often], each]), np.concatenate([n[~often], np.ones(len(each), np.int64)])
                key = np.concatenate([key[~often], text.mix(text.range_hashes(self.sums, each, each + WINDOW))])
                inner = np.concatenate([inner[~often], np.zeros(len(each), bool)])
        self.start, self.n, self.key, self.inner = start, n, key, inner
        self.single = np.arange(len(start)) >= len(start) - singles
        self.digest = text.range_hashes(self.sums, start, start + n + (WINDOW - 1))
        self.doc = np.searchsorted(self.at, start, side="right") - 1


def _window_min(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbours: of the rest of a block and the beginning of the next."""
    size = len(x) - wide + 1
    blocks = -(-len(x) // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:size], ahead[wide - 1 : wide - 1 + size])


def _short(key: np.ndarray) -> np.ndarray:
    """40 bits of each key, which counting and the sketch use."""
    return key >> np.uint64(24)


def _sent(shard: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a structured array dealt to shards, a packed row each, column by column."""
    order = np.argsort(shard, kind="stable")
    shard, rows = shard[order], rows[order]
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else [], len(shard)).astype(np.int64)
    if len(shard):
        yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), pa.array([_closed(rows[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["shard", "blob"])


def _closed(rows: np.ndarray) -> bytes:
    raw = b"".join(rows[name].tobytes() for name in rows.dtype.names)
    return np.int64(len(rows)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _opened(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    raw, out, at = pa.decompress(blob[8:], n * kind.itemsize, "zstd", asbytes=True), np.empty(n, kind), 0
    for name in kind.names:
        size = n * kind[name].itemsize
        out[name] = np.frombuffer(raw[at : at + size], kind[name])
        at += size
    return out


def _by_shard(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The rows of each shard; blobs come sorted by it."""
    at, held = None, []
    for b in batches:
        for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if shard != at and held:
                yield np.concatenate(held)
                held = []
            at = shard
            held.append(_opened(blob, kind))
    if held:
        yield np.concatenate(held)


def _gathered(df: DataFrame, shards: int) -> DataFrame:
    parts = max(1, min(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(parts, "shard").sortWithinPartitions("shard")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def repeated_keys(docs: DataFrame, shards: int) -> DataFrame:
    """key, n: 40-bit keys of several segments, and of how many different ones, about."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, budget=SLICE_BYTES):
            s = Segments(part.column(2))
            order = np.lexsort((s.digest, s.key))
            key, digest = s.key[order], s.digest[order]
            each = _starts(key, digest)
            short = _short(key)
            first = np.flatnonzero(_starts(short))
            different = np.add.reduceat(each.astype(np.int64), first) if len(first) else first
            more = (np.diff(np.append(first, len(key))) > different) | (np.add.reduceat(s.inner[order].astype(np.int64), first) > 0 if len(first) else False)
            rows = np.empty(len(first), COUNT)
            rows["low"], rows["high"], rows["n"] = short[first] & np.uint64(0xFFFFFFFF), short[first] >> np.uint64(32), np.minimum(different + more, 0xFFFF)
            yield from _sent((short[first] % np.uint64(shards)).astype(np.int64), rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches, COUNT):
            found, at = np.unique(rows["low"].astype(np.int64) | rows["high"].astype(np.int64) << 32, return_inverse=True)
            n = np.bincount(at.reshape(-1), weights=rows["n"], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1]), pa.array(n[n > 1])], ["key", "n"])

    return _gathered(docs.mapInArrow(send, BLOBS), shards).mapInArrow(add, "key long, n long")


def merged(of: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (of, start, end) in order, those of one ``of`` that touch as one."""
    order = np.lexsort((start, of))
    of, start, end = of[order], start[order], end[order]
    far = int(end.max(initial=0)) + 2
    at = np.cumsum(_starts(of)) - 1  # each document lies behind the one before
    reach = np.maximum.accumulate(end + at * far)
    first = np.flatnonzero(np.append(True, start[1:] + at[1:] * far > reach[:-1])[: len(of)])
    last = np.append(first, len(of))[1:] - 1
    return of[first], start[first], reach[last] - at[last] * far


def _marks(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans of the documents of ``rows``."""
    order = np.lexsort((rows["h"], rows["id"]))
    ids, hashes = rows["id"][order], rows["h"][order]
    new = _starts(ids, hashes)
    doc = np.empty(len(rows), np.int64)
    doc[order] = np.cumsum(new) - 1
    of, start, end = merged(doc, start, end)
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(ids[first][of]), pa.array(hashes[first][of]), pa.array(start), pa.array(end)], ["id", "h", "start", "end"])


def _ends(rows: np.ndarray) -> np.ndarray:
    return rows["start"] + rows["n"] + (WINDOW - 1)


def _candidates(docs: DataFrame, sketch, hot, shards: int) -> DataFrame:
    """The segments of repeated keys, equal ones of a slice once (``shard`` from 0), and the spans of the others (``shard`` -1)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, budget=SLICE_BYTES):
            s = Segments(part.column(2), hot.value)
            ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
            kept = s.single | store.marked(sketch.value, (_short(s.key) << np.uint64(24)).view(np.int64))
            rows = np.empty(int(kept.sum()), SEGMENT)
            rows["key"], rows["digest"], rows["start"], rows["n"] = s.key[kept], s.digest[kept], s.start[kept] - s.at[s.doc[kept]], s.n[kept]
            rows["inner"] = s.inner[kept]
            rows["id"], rows["h"] = ids[s.doc[kept]], hashes[s.doc[kept]]
            own, others = _first_of_equal(rows)
            marks = _marks(others, others["start"], _ends(others))
            n = marks.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1)), pa.nulls(n, pa.binary()), *marks.columns], ["shard", "blob", *marks.schema.names])
            own = own[np.lexsort((own["start"], own["h"], own["id"]))]
            for b in _sent((own["key"] % np.uint64(shards)).astype(np.int64), own):
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(b.num_rows, pa.int64())] * 4], ["shard", "blob", *marks.schema.names])

    return docs.mapInArrow(send, f"{BLOBS}, {MARKS}")


def _first_of_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal segments, ordered by key, and the others."""
    rows = rows[np.lexsort((rows["start"], rows["h"], rows["id"], rows["digest"], rows["key"]))]
    first = _starts(rows["key"], rows["digest"])
    return rows[first], rows[~first]


def _settled(candidates: DataFrame, shards: int) -> DataFrame:
    """Spans of repeats, and segments whose key has others (with their key), by document."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches, SEGMENT):
            own, others = _first_of_equal(rows)
            marks = _marks(others, others["start"], _ends(others))
            yield pa.RecordBatch.from_arrays([*marks.columns, pa.nulls(marks.num_rows, pa.int64())], [*marks.schema.names, "key"])
            first = np.flatnonzero(_starts(own["key"]))
            size = np.diff(np.append(first, len(own)))
            several = np.repeat((size > 1) | (np.add.reduceat(own["inner"].astype(np.int64), first) > 0 if len(first) else False), size)
            own = own[several]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own["id"], own["h"], own["start"], _ends(own), own["key"].view(np.int64))], ["id", "h", "start", "end", "key"])

    return _gathered(candidates.where("shard >= 0").select("shard", "blob"), shards).mapInArrow(settle, f"{MARKS}, key long")


def _with_spans(docs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The texts that have rows, with those: a text has one a window at most."""
    by_doc = rows.groupBy("id", "h").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return store.sifted(docs, rows.select("id", "h"), ["id", "h"]).join(by_doc, ["id", "h"])


def _listed(column: pa.Array, name: str) -> np.ndarray:
    return column.flatten().field(name).to_numpy(zero_copy_only=False)


def _gather(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``buf`` end to end."""
    at = np.cumsum(size) - size
    return buf[np.repeat(begin - at, size) + np.arange(int(size.sum()))]


def _sorted_repeats(docs: DataFrame, settled: DataFrame, shards: int) -> DataFrame:
    """Spans of the windows that a suffix array shows to start earlier elsewhere."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text.slices(batches, budget=4 * SLICE_BYTES):
            buf, at = text.bytes_of(b.column(2))
            doc = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy(zero_copy_only=False))
            rows = np.zeros(len(doc), SEGMENT)
            rows["key"], rows["start"] = _listed(b.column(3), "key").view(np.uint64), _listed(b.column(3), "start")
            size = _listed(b.column(3), "end") - rows["start"]
            rows["n"], rows["id"], rows["h"] = size - (WINDOW - 1), b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc]
            shard = (rows["key"] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            first = np.flatnonzero(_starts(shard[order]))
            for lo, hi in zip(first, np.append(first, len(order))[1:], strict=True):
                some = order[lo:hi]
                raw = _gather(buf, at[doc[some]] + rows["start"][some], size[some])
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[some[0]])]), pa.array([_closed(rows[some])], pa.binary()), pa.array([pa.compress(raw.tobytes(), "zstd", asbytes=True)], pa.binary())], ["shard", "blob", "bytes"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # suffix arrays make many small lists and no cycles
        for rows, buf in _segments_by_shard(batches):
            yield from _judged(rows, buf)
        gc.enable()

    wanted = settled.where("key IS NOT NULL")
    sent = _with_spans(docs, wanted, ["key", "start", "end"]).select("id", "h", F.col("text").cast("binary").alias("text"), "rows").mapInArrow(cut, BLOBS + ", bytes binary")
    return _gathered(sent, shards).mapInArrow(judge, MARKS)


def _segments_by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The segments of a shard, and their bytes end to end."""
    at, held, pieces = None, [], []
    for b in batches:
        for shard, blob, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if shard != at and held:
                yield np.concatenate(held), np.concatenate(pieces)
                held, pieces = [], []
            at = shard
            held.append(_opened(blob, SEGMENT))
            pieces.append(np.frombuffer(pa.decompress(raw, int((held[-1]["n"].astype(np.int64) + WINDOW - 1).sum()), "zstd", asbytes=True), np.uint8))
    if held:
        yield np.concatenate(held), np.concatenate(pieces)


def _by_whole_keys(rows: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, ordered by key, of about ``budget`` bytes, that part no key."""
    ends = np.cumsum(rows["n"].astype(np.int64) + WINDOW)
    first = np.flatnonzero(_starts(rows["key"]))
    stops, at = np.append(first, len(rows))[1:], 0
    while at < len(first):
        base = ends[first[at] - 1] if first[at] else 0
        to = max(at + 1, int(np.searchsorted(ends[stops - 1], base + budget, side="right")))
        yield int(first[at]), int(stops[to - 1])
        at = to


def _judged(rows: np.ndarray, buf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments in the order of their keys, as many whole keys to a suffix array as ``ARRAY_BYTES`` hold. Before that, windows whose
    hash no other window of these keys has are cut off both ends: they repeat nothing."""
    size = rows["n"].astype(np.int64) + (WINDOW - 1)
    begin = np.cumsum(size) - size
    order = np.argsort(rows["key"], kind="stable")
    rows, begin = rows[order], begin[order]
    for a, b in _by_whole_keys(rows, SIEVED_BYTES):
        some = rows[a:b]
        n = some["n"].astype(np.int64)
        raw = _gather(buf, begin[a:b], n + (WINDOW - 1))
        at = np.cumsum(n + (WINDOW - 1)) - (n + (WINDOW - 1))
        of = np.repeat(np.arange(len(some)), n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        sums = text.Words(raw, at, *[np.zeros(0, np.int64)] * 4).prefix_sums()
        hashes = text.range_hashes(sums, at[of] + inside, at[of] + inside + WINDOW)
        ordered = np.argsort(hashes)
        same = ~_starts(hashes[ordered])
        twice = np.zeros(len(of), bool)
        twice[ordered] = same | np.append(same[1:], False)
        of, inside = of[twice], inside[twice]
        left = np.flatnonzero(_starts(of))
        if not len(left):
            continue
        low, high = inside[left], inside[np.append(left, len(of))[1:] - 1]
        some, at = some[of[left]], at[of[left]] + low
        some["start"] += low
        some["n"] = high - low + 1
        for c, d in _by_whole_keys(some, ARRAY_BYTES):
            part = some[c:d]
            later, position = repeats([raw[x : x + m + WINDOW - 1].tobytes() for x, m in zip(at[c:d].tolist(), part["n"].tolist(), strict=True)], part)
            yield _marks(part[later], position, position + WINDOW)


def repeats(pieces: list[bytes], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal an earlier one: the row and where the window starts in its document."""
    joined = b"\0".join(pieces)
    buf = np.frombuffer(joined, np.uint8)
    n = rows["n"].astype(np.int64)
    begin = np.cumsum(n + WINDOW) - (n + WINDOW)
    symbols = buf.astype(np.int64) + 2
    symbols[(begin + n + WINDOW - 1)[:-1]] = 1  # between segments; no window crosses it
    order = suffix_array([*symbols.tolist(), 0])
    of = np.repeat(np.arange(len(rows)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    window = np.full(len(joined) + 1, -1, np.int64)
    window[begin[of] + inside] = np.arange(len(of))
    listed = window[order]
    listed = listed[listed >= 0]  # windows in the order of suffixes
    where = begin[of] + inside
    same = np.zeros(len(listed), bool)
    step = np.arange(WINDOW)
    for lo in range(1, len(listed), 4096):
        here = where[listed[lo - 1 : lo + 4096]]
        bytes_ = buf[here[:, None] + step]
        same[lo : lo + 4096] = (bytes_[1:] == bytes_[:-1]).all(axis=1)
    position = rows["start"][of] + inside
    rank = np.empty(len(of), np.int64)
    rank[np.lexsort((position, rows["h"][of], rows["id"][of]))] = np.arange(len(of))
    run = np.flatnonzero(~same)
    least = np.minimum.reduceat(rank[listed], run) if len(run) else run
    first = np.repeat(least, np.diff(np.append(run, len(listed))))
    later = listed[rank[listed] != first]
    return of[later], position[later]


def keyed(docs: DataFrame) -> DataFrame:
    """id (LAST for null), h, text: what tells documents apart and orders them."""
    null = F.col("doc_id").isNull()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text", null).alias("h"), F.coalesce("text", F.lit("")).alias("text"), null.alias("no_id"))


def spans(docs: DataFrame) -> DataFrame:
    """``keyed`` rows, no two of the same id and h -> id, h, start, end: what has to go; spans may overlap."""
    spark = docs.sparkSession
    docs = docs.select("id", "h", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (WIDE // 2) // KEYS_A_SHARD)
    keys = store.saved(repeated_keys(docs, shards), "repeated-keys")
    total = keys.agg(F.sum("n")).collect()[0][0] or 0
    hot = [r["key"] for r in keys.where(F.col("n") > max(HOT, total >> 16)).select("key").collect()]  # 2^16 of them at most
    sketch = spark.sparkContext.broadcast(store.sketch(keys.select(F.shiftleft("key", 24))))
    often = spark.sparkContext.broadcast(np.sort(np.array(hot, np.uint64)))
    found = store.saved(_candidates(docs, sketch, often, shards), "segments")
    settled = store.saved(_settled(found, shards), "settled")
    names = ["id", "h", "start", "end"]
    parts = [found.where("shard < 0").select(*names), settled.where("key IS NULL").select(*names), _sorted_repeats(docs, settled, shards)]
    marks = store.saved(parts[0].unionByName(parts[1]).unionByName(parts[2]), "repeats")
    store.delete(keys, found, settled)
    return marks


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (an array of start and end, in bytes), kept (the bytes that stay) of every document."""
    rows = keyed(docs)
    again = store.saved(rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "h"), "again")
    copies = None
    if again.limit(1).count():
        same = store.saved(counts.joined_by_size(rows, again, ["id", "h"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "copies")
        first = same.groupBy("id", "h").agg(F.min("row").alias("row"))
        told = counts.joined_by_size(same, first.withColumnRenamed("row", "first"), ["id", "h"], "inner")
        copies = told.where("row != first")
        rows = counts.joined_by_size(rows, again, ["id", "h"], "left_anti").unionByName(told.where("row = first").select(*rows.columns))
    marks = spans(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in text.slices(batches, budget=4 * SLICE_BYTES):
            buf, at = text.bytes_of(b.column(1))
            doc = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            of, start, end = merged(doc, _listed(b.column(2), "start"), _listed(b.column(2), "end"))
            edge = np.zeros(len(buf) + 1, np.int32)
            np.add.at(edge, at[of] + start, 1)
            np.add.at(edge, at[of] + end, -1)
            stays = np.cumsum(edge[:-1]) == 0
            before = np.append(0, np.cumsum(stays))[at]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[stays]))])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), lists.cast(kind), kept.cast(pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    doc_id, raw = F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.col("text").cast("binary")
    touched = _with_spans(rows, marks, ["start", "end"]).select(doc_id, raw.alias("text"), "rows").mapInArrow(cut, schema)
    whole = counts.joined_by_size(rows, marks.select("id", "h").distinct(), ["id", "h"], "left_anti").select(doc_id, F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() AS array<struct<start: long, end: long>>)").alias("spans"), raw.alias("kept"))
    out = touched.unionByName(whole)
    if copies is not None:
        long = F.octet_length("text").cast("long")
        gone = F.when(long >= WINDOW, F.array(F.struct(F.lit(0).cast("long").alias("start"), long.alias("end")))).otherwise(F.expr("cast(array() AS array<struct<start: long, end: long>>)"))
        out = out.unionByName(copies.select(doc_id, long.alias("n_bytes"), gone.alias("spans"), F.when(long >= WINDOW, F.lit(b"")).otherwise(raw).alias("kept")))
    return out
