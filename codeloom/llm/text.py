"""Words, shingles and 64-bit hashes of Arrow text columns, computed by numpy over whole batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE = 5

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("p", ())) < n:
        size = max(n, SLICE_BYTES) + 1
        for name, base in (("p", _P), ("i", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps, dtype=np.uint64)
    return _TABLES["p"], _TABLES["i"]


@dataclass
class Words:
    """The words of a slice of documents: byte ranges in ``buf`` and the document of each."""

    buf: np.ndarray  # uint8, all documents end to end
    doc_byte: np.ndarray  # int64, n_docs + 1
    start: np.ndarray  # int64, by word
    end: np.ndarray
    doc: np.ndarray  # int64, by word
    doc_word: np.ndarray  # int64, n_docs + 1: the first word of each document

    @property
    def n_docs(self) -> int:
        return len(self.doc_byte) - 1

    def prefix_sums(self) -> np.ndarray:
        power, _ = _powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[: len(self.buf)], out=sums[1:], dtype=np.uint64)
        return sums

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, finalised. Some words at a time, as sums take 8 bytes a byte."""
        out, at = np.empty(len(self.start), np.uint64), 0
        while at < len(out):
            lo = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + SLICE_BYTES, side="right")))
            here = Words(self.buf[lo : self.end[to - 1]], self.doc_byte, self.start[at:to] - lo, self.end[at:to] - lo, self.doc, self.doc_word)
            out[at:to] = range_hashes(here.prefix_sums(), here.start, here.end)
            at = to
        return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(sums))
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw + (end - start).astype(np.uint64) * _ODD[4])


def hash_bytes(word: bytes) -> int:
    """The hash that ``Words.hashes`` gives this word."""
    buf = np.frombuffer(word, np.uint8)
    w = Words(buf, np.array([0, len(buf)]), np.array([0]), np.array([len(buf)]), np.array([0]), np.array([0, 1]))
    return int(w.hashes()[0])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and where each row starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def folded(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals U+00C0 to U+00DE in lower case."""
    buf = _LOWER[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    return np.where(after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97), buf + 32, buf).astype(np.uint8)


def words_of(column: pa.Array, lower: bool = False, letters: bool = False, digits: bool = False) -> Words:
    """``letters``: words are runs of letters (and digits) and of bytes beyond ASCII, in lower case, instead."""
    buf, doc_byte = bytes_of(column)
    if letters:
        buf = folded(buf)
    elif lower:
        buf = _LOWER[buf]
    n = len(buf)
    solid = _LETTER[buf] if letters else ~_IS_SPACE[buf]
    if letters and digits:
        solid |= (buf >= 48) & (buf <= 57)
    first = np.ones(n + 1, bool)  # a boundary lies before this byte
    first[1:n] = ~solid[:-1]
    first[doc_byte] = True
    start = np.flatnonzero(solid & first[:n])
    last = np.ones(n, bool)
    if n:
        last[:-1] = first[1:n] | ~solid[1:]
    end = np.flatnonzero(solid & last) + 1
    doc = np.searchsorted(doc_byte, start, side="right") - 1
    doc_word = np.searchsorted(start, doc_byte, side="left")
    return Words(buf, doc_byte, start, end, doc, doc_word)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``budget`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + budget, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shingles(w: Words, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``size`` words; a shorter document with words has one, of all its words."""
    lo, hi = w.doc_word[:-1], w.doc_word[1:]
    counts = np.where(hi > lo, np.maximum(hi - lo - size + 1, 1), 0)
    doc = np.repeat(np.arange(w.n_docs), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[doc]
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    stop = hi[doc]
    total = np.zeros(len(doc), np.uint64)
    for k in range(size):
        part = padded[at + k] * _ODD[k % 5] + np.uint64(k + 1)
        total += part if k == 0 else np.where(at + k < stop, part, np.uint64(0))
    return doc, mix(total)


def counted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, value), ordered, with counts. ``doc`` is ascending."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
