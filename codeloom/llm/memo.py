"""Words between single spaces and line feeds, and a bounded table that remembers what is known of each by its hash.

A 64-bit hash stands for a word; two of ten million words share one with a chance of 3 in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import text

START, SPACE, FEED = 0, 1, 2  # what precedes a word
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def chunks_of(column: pa.Array, bad: np.ndarray | None = None) -> tuple[text.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of each document, what precedes each (START, SPACE, FEED), their hashes, and which documents are
    irregular: with separators next to each other, at the start or at the end, or with a byte at which ``bad`` is true."""
    buf, doc_byte = text.bytes_of(column)
    n = len(buf)
    gap = (buf == 32) | (buf == 10)
    irregular = np.zeros(len(doc_byte) - 1, bool)
    edge = np.zeros(n + 1, bool)
    edge[doc_byte] = True
    wrong = gap & (edge[:n] | edge[1:] | np.append(gap[1:], False))
    if bad is not None:
        wrong |= bad
    irregular[np.searchsorted(doc_byte, np.flatnonzero(wrong), side="right") - 1] = True
    first = edge.copy()
    first[1:] |= gap
    start = np.flatnonzero(first[:n] & ~gap)
    end = np.flatnonzero(~gap & (edge[1:] | np.append(gap[1:], True))) + 1
    doc = np.searchsorted(doc_byte, start, side="right") - 1
    keep = ~irregular[doc]
    start, end, doc = start[keep], end[keep], doc[keep]
    kind = np.where(edge[start], START, np.where(buf[start - 1] == 32, SPACE, FEED))
    words = text.Words(buf, doc_byte, start, end, doc, np.searchsorted(doc, np.arange(len(doc_byte))))
    return words, kind, words.hashes(), irregular


def keyed(hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return text.mix(hashes + _ODD[kind])


class Table:
    """Sorted keys with rows of numbers; it begins afresh beyond ``limit`` keys."""

    def __init__(self, limit: int, width: int) -> None:
        self.limit, self.width = limit, width
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.zeros(0, np.uint64), np.zeros((0, self.width), np.int64)) for _ in range(2)]  # old, recent

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and which were found."""
        rows, hit = np.zeros((len(keys), self.width), np.int64), np.zeros(len(keys), bool)
        for known, values in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[at] == keys
                rows[same] = values[at[same]]
                hit |= same
        return rows, hit

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """New keys, none of them known."""
        self.parts[1] = self._merged(self.parts[1], (keys, rows))
        if len(self.parts[1][0]) > 100_000:
            self.parts = [self._merged(*self.parts), (np.zeros(0, np.uint64), np.zeros((0, self.width), np.int64))]

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]
