"""Benchmark decontamination: a BM25 inverted index of the test items, asked about every passage of the training texts.

Words are runs of letters and digits in lower case. Passages are windows of ``WINDOW`` words at every ``STEP``
words. An item is a candidate for a passage whose BM25 score reaches ``SHARE`` of the item's score for its own
text (less for items longer than a window, in proportion); impacts are divided by that requirement, so the
threshold is 1 for all items. The number of items, their mean length and the document frequencies are those of all items.

The index holds a posting list a term, in order of items, with the maximum of each list and of each block of ``POSTINGS``
postings. A passage is passed over whole if in no range of ``RANGE`` items the maxima of its terms add up to the threshold. The
others are searched by block-max WAND, for many passages in step: lists are ordered by their current item, the pivot is
the first at which the list maxima add up to the threshold; where the maxima of the blocks around the pivot item do not, all
lists up to it skip to the end of these blocks; else those before it skip to it, or the item is scored. A candidate is
verified on the text around the passage: the share of the item's word 5-grams found there must be at least 0.8,
and at least half of those of its question (first half, or the ``text`` if there is an ``answer``) and of its
answer.

An index takes at most about ``INDEX_BYTES`` (and one item); more items make several, dealt by hash, and the corpus is read once
for each. Scores are the same however items are dealt.

Cases: null and empty texts and items without words match nothing; items of fewer than five words must be found as
they are; equal items of different ids are all reported, rows of one id and text are one item; repeated documents and null
ids are kept; very long texts are searched whole; no rows or no items give no leaks; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

WINDOW, STEP = 64, 32
SHARE = 0.5
K1, B = 1.2, 0.75
POSTINGS = 32  # of a block
RANGE, COMMON = 4, 64
INDEX_BYTES = 64 << 20
POSTING_BYTES = 64  # that a word of an item takes in the index, at most
BATCH = 1 << 16  # terms of passages searched in step
NEARLY = 1 - 1e-4  # the threshold, with room for rounding
OVERLAP, PART_OVERLAP = 0.8, 0.5
_SURE = WINDOW - STEP // 2  # of an item no longer than a window, so many words lie in one window at least
_DONE = np.int64(1 << 31)  # past the last item


@dataclass
class Index:
    """Posting lists of terms: items in order and their impacts; by block, the last item and the greatest impact."""

    ids: list
    words: list[np.ndarray]  # by item: hashes of its words
    cut: list[int]  # by item: words of the question
    terms: np.ndarray  # sorted hashes
    start: np.ndarray  # by term: its first posting (one more at the end)
    impact: np.ndarray  # by posting
    list_max: np.ndarray  # by term
    post_key: np.ndarray  # by posting: term << 32 | item
    block_key: np.ndarray  # by block: term << 32 | last item
    block_max: np.ndarray
    range_start: np.ndarray  # by term: its first range of ``RANGE`` items (one more at the end)
    range_of: np.ndarray  # by term and range: the range, and the greatest impact there
    range_max: np.ndarray

    def reachable(self, window: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """By window, whether the maxima of its terms within any range of items add up to the threshold. Terms of more than
        ``COMMON`` ranges count with the maximum of their list."""
        ranges = np.diff(self.range_start)[term]
        often = ranges > COMMON
        base = np.bincount(window[often], self.list_max[term[often]], n)
        window, term, ranges = window[~often], term[~often], ranges[~often]
        at = np.repeat(self.range_start[term] - (np.cumsum(ranges) - ranges), ranges) + np.arange(ranges.sum())
        key = np.repeat(window, ranges) << 32 | self.range_of[at]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        out = base >= NEARLY
        if len(first):
            own = key[first] >> 32
            out[own[np.add.reduceat(self.range_max[at[order]].astype(float), first) + base[own] >= NEARLY]] = True
        return out

    def search(self, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, term), distinct and ascending -> (window, item, score) of all items that score at least 1."""
        first = np.flatnonzero(np.diff(window, prepend=-1))
        n = np.diff(np.append(first, len(window)))
        by_size = np.argsort(n, kind="stable")
        at = 0
        while at < len(first):
            to = at + max(1, int(np.searchsorted(np.arange(1, len(first) - at + 1) * n[by_size[at:]], BATCH, side="right")))
            rows = by_size[at:to]
            width = int(n[rows].max())
            place = np.arange(width)[None, :]
            own = place < n[rows][:, None]
            terms = np.where(own, term[np.minimum(first[rows][:, None] + place, len(term) - 1)], 0)
            yield from self._wand(window[first[rows]], terms, own)
            at = to

    def _wand(self, window: np.ndarray, term: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        base = term.astype(np.int64) << 32
        at, end = np.where(own, self.start[term], 0), np.where(own, self.start[term + 1], 0)
        most = np.where(own, self.list_max[term], np.float32(0))
        last = len(self.post_key) - 1

        def items(at: np.ndarray, end: np.ndarray) -> np.ndarray:
            return np.where(at < end, self.post_key[np.minimum(at, last)] & 0xFFFFFFFF, _DONE)

        now = items(at, end)
        while len(window):
            order = np.argsort(now, axis=1)
            base, at, end, most, now = (np.take_along_axis(x, order, axis=1) for x in (base, at, end, most, now))
            bound = np.cumsum(np.where(now < _DONE, most, 0), axis=1)
            live = bound[:, -1] >= NEARLY
            if not live.all():
                window, base, at, end, most, now, bound = (x[live] for x in (window, base, at, end, most, now, bound))
                if not len(window):
                    return
            row = np.arange(len(window))
            pivot = now[row, (bound >= NEARLY).argmax(axis=1)]
            before = now <= pivot[:, None]
            r, c = np.nonzero(before)
            wanted = base[r, c] + pivot[r]
            block = np.minimum(np.searchsorted(self.block_key, wanted), len(self.block_key) - 1)
            inside = self.block_key[block] >> 32 == base[r, c] >> 32
            bounds = np.bincount(r, np.where(inside, self.block_max[block], 0), len(row))
            good = bounds >= NEARLY
            # scored: all lists up to the pivot stand on it
            score = good & (now[:, 0] == pivot)
            if score.any():
                hit = (now == pivot[:, None]) & score[:, None]
                sums = np.where(hit, self.impact[np.minimum(at, last)], 0).sum(axis=1)
                found = np.flatnonzero(score & (sums >= NEARLY))
                if len(found):
                    yield window[found], pivot[found], sums[found]
                at = at + hit
            # others skip to the pivot, or past the blocks around it
            ends = np.full(len(row), _DONE)
            np.minimum.at(ends, r, np.where(inside, (self.block_key[block] & 0xFFFFFFFF) + 1, _DONE))
            beyond = np.where(before, _DONE, now).min(axis=1)
            target = np.where(good, pivot, np.minimum(ends, beyond))
            move = (~score[r]) & (now[r, c] < target[r])
            r, c = r[move], c[move]
            at[r, c] = np.minimum(np.searchsorted(self.post_key, base[r, c] + np.minimum(target[r], 0xFFFFFFFF)), end[r, c])
            now = items(at, end)


def _words_of(columns: list[pa.Array]) -> tuple[list[np.ndarray], list[int]]:
    """By item the hashes of its words, and how many are of the first part; ``columns``: text and answer."""
    parts = [x or "" for pair in zip(*(c.to_pylist() for c in columns), strict=True) for x in pair]
    words = text.words_of(pa.array(parts, pa.string()), letters=True, digits=True)
    hashes = words.hashes()
    n = len(parts) // 2
    of = [hashes[words.doc_word[2 * i] : words.doc_word[2 * i + 2]] for i in range(n)]
    cut = [int(words.doc_word[2 * i + 1] - words.doc_word[2 * i]) for i in range(n)]
    return of, [c if columns[1][i].is_valid else len(of[i]) // 2 for i, c in enumerate(cut)]


def built(items: pa.Table, n_items: int, mean_length: float, frequency: tuple[np.ndarray, np.ndarray]) -> Index:
    """The index of ``items`` (item_id, text, answer) by the statistics of all; ``frequency``: sorted terms and in how many items they are."""
    of, cut = _words_of([items["text"].combine_chunks(), items["answer"].combine_chunks()])
    item = np.repeat(np.arange(len(of)), [len(x) for x in of])
    item, value, tf = text.counted(item, np.concatenate(of) if of else np.zeros(0, np.uint64))
    df = frequency[1][np.searchsorted(frequency[0], value)] if len(value) else np.zeros(0)
    length = np.array([len(x) for x in of], float)
    impact = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(mean_length, 1e-9)))
    needed = SHARE * np.bincount(item, impact, len(of)) * np.minimum(1, _SURE / np.maximum(length, 1))
    terms, term = np.unique(value, return_inverse=True)
    order = np.lexsort((item, term))
    item, term, impact = item[order], term[order], (impact / needed[item])[order].astype(np.float32)
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    block = np.cumsum((np.arange(len(term)) - start[term]) % POSTINGS == 0) - 1
    ends = np.flatnonzero(np.diff(block, append=block[-1] + 1)) if len(block) else np.zeros(0, np.int64)
    first = np.append(0, ends[:-1] + 1) if len(ends) else ends
    key = term.astype(np.int64) << 32 | item
    ranged = np.flatnonzero(np.diff(term.astype(np.int64) << 32 | item // RANGE, prepend=-1))
    return Index(
        items["item_id"].to_pylist(), of, cut, terms, start, impact,
        np.maximum.reduceat(impact, start[:-1]) if len(terms) else impact, key, key[ends], np.maximum.reduceat(impact, first) if len(first) else impact,
        np.searchsorted(term[ranged], np.arange(len(terms) + 1)), item[ranged] // RANGE, np.maximum.reduceat(impact, ranged) if len(ranged) else impact,
    )


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = text.mix(out * np.uint64(31) + words[k : len(words) - size + 1 + k])
    return out


def _overlaps(item: np.ndarray, cut: int, around: np.ndarray) -> tuple[float, float, float]:
    """Shares of the item's n-grams found in ``around``: of all, of the question's and of the answer's."""
    size = min(text.SHINGLE, len(item))
    hit = np.isin(_grams(item, size), _grams(around, size))
    split = min(max(cut - size // 2, 1), len(hit))  # an n-gram belongs to the part of its middle
    question, answer = hit[:split], hit[split:]
    return float(hit.mean()), float(question.mean()), float(answer.mean()) if len(answer) else float(hit.mean())


def _windows(words: text.Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and end of each window; (window, term), distinct and ascending. ``known``: the term of each word, or -1."""
    n = np.diff(words.doc_word)
    count = np.where(n > 0, np.maximum(-(-n // STEP) - 1, 1), 0)  # a last half lies in the window before it
    ahead = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = words.doc_word[doc] + (np.arange(ahead[-1]) - ahead[doc]) * STEP
    at = np.flatnonzero(known >= 0)
    place = (at - words.doc_word[words.doc[at]]) // STEP
    own = ahead[words.doc[at]]
    most = count[words.doc[at]] - 1
    both = np.concatenate([(own + place)[place <= most], (own + place - 1)[place > 0]])
    term = np.concatenate([known[at[place <= most]], known[at[place > 0]]])
    pairs = np.unique(both << 32 | term)
    return start, np.minimum(start + WINDOW, words.doc_word[doc + 1]), pairs >> 32, pairs & 0xFFFFFFFF


def leaks_in(column: pa.Array, index: Index) -> list[tuple[int, int, int, float, float, float, float]]:
    """(row, item, word of the passage, score, overlaps) of the verified items in each text, the best passage of each."""
    words = text.words_of(column, letters=True, digits=True)
    if not len(index.terms) or not len(words.doc):
        return []
    hashes = words.hashes()
    to = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    start, end, window, term = _windows(words, np.where(index.terms[to] == hashes, to, -1))
    can = index.reachable(window, term, len(start))[window]
    best: dict[tuple[int, int], tuple] = {}
    for windows, items, scores in index.search(window[can], term[can]):
        for w, item, score in zip(windows.tolist(), items.tolist(), scores.tolist(), strict=True):
            a, b = int(start[w]), int(end[w])
            row = int(words.doc[a])
            lo, hi = int(words.doc_word[row]), int(words.doc_word[row + 1])
            own = index.words[item]
            share, question, answer = _overlaps(own, index.cut[item], hashes[max(lo, a - len(own)) : min(hi, b + len(own))])
            if share >= OVERLAP and min(question, answer) >= PART_OVERLAP:
                got = (row, item, a - lo, score, share, question, answer)
                if (share, score, lo - a) > (lambda o: (o[4], o[3], -o[2]))(best.get((row, item), (0, 0, 0, -1.0, -1.0))):
                    best[row, item] = got
    return [best[k] for k in sorted(best)]


def indexes(items: DataFrame, size: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of about ``size`` bytes at most each."""
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer")).distinct()
    rows = store.saved(rows, "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, _ = _words_of([batch.column(1), batch.column(2)])
            value, n = np.unique(np.concatenate([np.unique(x) for x in of]) if of else np.zeros(0, np.uint64), return_counts=True)
            some = np.append(value, np.uint64(0))  # the last row: items and words
            yield pa.RecordBatch.from_arrays([text.as_i64(some), pa.array(np.append(n, len(of))), pa.array(np.append(np.zeros(len(n), np.int64), sum(map(len, of)))), pa.array(np.append(np.zeros(len(n), bool), True))], ["term", "n", "words", "total"])

    counted = store.saved(rows.mapInArrow(count, "term long, n long, words long, total boolean").groupBy("total", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "item-terms")
    totals = counted.where("total").collect()
    n_items, n_words = (int(totals[0]["n"]), int(totals[0]["words"])) if totals else (0, 0)
    parts = max(1, -(-n_words * POSTING_BYTES // size))
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text", "answer"), F.lit(parts)))
    for k in range(parts):
        own = numbered.where(F.col("part") == k).drop("part")
        terms = counted.where("NOT total")
        if parts > 1:
            terms = terms.join(own.mapInArrow(count, "term long, n long, words long, total boolean").where("NOT total").select("term").distinct(), "term", "left_semi")
        table = terms.select("term", "n").toArrow()
        key = table["term"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        yield built(own.toArrow(), n_items, n_words / max(n_items, 1), (key[order], table["n"].to_numpy()[order]))


def leaks(docs: DataFrame, items: DataFrame, size: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, at_word, score, overlap, question_overlap, answer_overlap: one row a document and item.
    What an index finds is saved before the next one is sent, so one index at a time is held."""
    spark, found, part, shared = docs.sparkSession, None, None, None
    source = docs.select(F.col("doc_id").cast("long"), "text")
    for index in indexes(items, size):
        if part is not None:
            part = store.saved(part, "leaks")
            found = part if found is None else found.union(part)
            shared.destroy()
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in text.slices(batches):
                got = leaks_in(piece.column(1), shared.value)
                ids = piece.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                items_ = pa.array([shared.value.ids[g[1]] for g in got], pa.int64())
                rest = [pa.array([g[k] for g in got], pa.int64() if k == 2 else pa.float64()) for k in range(2, 7)]
                yield pa.RecordBatch.from_arrays([ids, items_, *rest], ["doc_id", "item_id", "at_word", "score", "overlap", "question_overlap", "answer_overlap"])

        part = source.mapInArrow(scan, "doc_id long, item_id long, at_word long, score double, overlap double, question_overlap double, answer_overlap double")
    return part if found is None else found.union(part)


def clean(docs: DataFrame, items: DataFrame, size: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item was found. What an index leaves is saved before the next one is sent."""
    shared = None
    for index in indexes(items, size):
        if shared is not None:
            docs = store.saved(docs, "clean")
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in text.slices(batches):
                bad = {g[0] for g in leaks_in(piece.column(piece.schema.get_field_index("text")), shared.value)}
                yield piece.filter(pa.array([i not in bad for i in range(piece.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
