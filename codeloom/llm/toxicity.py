"""Toxicity by two Kneser-Ney models, of toxic and of ordinary text.

Words (letters only, lower case) are modelled by the word before (a start, for the first). In each class the bigram's
discounted share is interpolated with the class's continuation probability, the discounted share of the distinct words
before it; that is interpolated with the continuation probability of both classes together, and that with one over the
number of known words. A word that neither class knows gets the rest of that mass and is spelled piece by piece (its
first 3 bytes, its first 5 given those, and so on) by interpolated estimates of the same kind, so new forms of a word
are judged by its stem. Every bigram, word and piece is scored. Bigrams and pieces are counted by documents, as a
phrase repeated in one text is one piece of evidence. The score of a text is a logistic of the difference of its two
log-likelihoods, each divided by the number of words; slope and offset are fitted on labelled documents that the
counts leave out.

The counts come from at most ``SAMPLE`` labelled documents (those of the lowest hash), so the model's size is
bounded and it is broadcast; every document is scored, whole.

Cases: null, empty and word-less texts score as the offset gives (a length-normalised difference of 0); equal texts
score equally; with no labelled documents of one of the classes all scores are the share of toxic labels (0.0 with
none); labels that disagree count for both; rows with a null label or ``doc_id`` train nothing; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts, store, text

SAMPLE = 8000  # labelled documents that the model is fitted on, at most
CALIBRATION = 4  # one in so many of them sets the slope and the offset
LENGTHS = (3, 5, 7, 9)
DISCOUNT = 0.75
SLICE_BYTES = 1 << 20
BLOCK = 1 << 17  # rows of the model that are estimated at a time
START = np.uint64(text.hash_bytes(b"\0start"))
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_ROOT = np.uint64(0x14057B7EF767814F)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def pieces(words: text.Words, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the preceding piece, the piece, and whether the word goes on so far. ``keep``: of which words."""
    sums = words.prefix_sums()
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    before, alive = np.full(len(start), _ROOT), np.ones(len(start), bool)
    for k, n in enumerate((*LENGTHS, None)):
        stop = end if n is None else np.minimum(end, start + n)
        ended = stop == end
        piece = text.mix(text.range_hashes(sums, start, stop) + np.uint64(k + 1) + np.where(ended, _WHOLE, np.uint64(0)))
        yield before, piece, alive
        before, alive = piece, alive & ~ended


def pair_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return text.mix(context * _A + token * _B)


def stream(words: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, and the word."""
    token = words.hashes()
    before = np.concatenate([token[:1], token[:-1]])
    first = words.doc_word[:-1]
    before[first[first < words.doc_word[1:]]] = START
    return before, token


@dataclass
class Table:
    """Sorted hashes with a number each."""

    key: np.ndarray
    value: np.ndarray

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers (0 where there is none), and where there is one."""
        if not len(self.key):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        hit = self.key[at] == keys
        return np.where(hit, self.value[at], 0.0), hit


def _table(key: np.ndarray, value: np.ndarray) -> Table:
    order = np.argsort(key)
    return Table(key[order], value[order])


@dataclass
class Model:
    """Log ratios of toxic to ordinary: of bigrams, of words where the bigram is new, of pieces where the word is new. A context
    gives new events the same weight in both classes, so what none of them has seen has a ratio of 1."""

    pairs: Table
    words: Table
    spelled: Table
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def word_ratios(self, words: text.Words) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary), by word."""
        before, token = stream(words)
        _, first, back = np.unique(token, return_index=True, return_inverse=True)
        ratio, known = self.words.get(token[first])
        new = np.flatnonzero(~known)
        for _, piece, alive in pieces(words, first[new]):
            ratio[new] += np.where(alive, self.spelled.get(piece)[0], 0.0)
        keys, at, again = np.unique(pair_key(before, token), return_index=True, return_inverse=True)
        r, hit = self.pairs.get(keys)
        return np.where(hit, r, ratio[back][at])[again]

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if self.constant is not None:
            return np.full(n, self.constant)
        means = self.means(column)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.arcsinh(means * 1000) + self.offset, -500, 500)))

    def means(self, column: pa.Array) -> np.ndarray:
        words = text.words_of(column, letters=True)
        sums = np.bincount(words.doc, self.word_ratios(words), minlength=words.n_docs) if len(words.doc) else np.zeros(words.n_docs)
        return sums / np.maximum(np.diff(words.doc_word), 1)


def _blocks(n: int) -> list[slice]:
    return [slice(at, at + BLOCK) for at in range(0, n, BLOCK)]


def _apart(toxic: np.ndarray, ordinary: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each event the posterior probability that its share of toxic counts is its own (any is as likely) and not the one
    expected; the prior is fitted to all events at hand."""
    most = int((toxic + ordinary).max(initial=0))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    own, blocks = np.empty(len(toxic), np.float32), _blocks(len(toxic))
    for s in blocks:
        t, o = toxic[s].astype(np.int64), ordinary[s].astype(np.int64)
        p = np.clip(share[s].astype(float), 1e-6, 1 - 1e-6)
        own[s] = -np.log(t + o + 1.0) - (logs[t + o] - logs[t] - logs[o]) - t * np.log(p) - o * np.log(1 - p)
    prior, evidence = 0.01, own.copy()
    for _ in range(30):
        for s in blocks:
            own[s] = 1 / (1 + np.exp(-np.clip(evidence[s] + np.log(prior / (1 - prior)), -50, 50)))
        prior = float(np.clip(own.mean(dtype=float) if len(own) else prior, 1e-7, 0.5))
    return own


def _level(before: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, lower: list[np.ndarray], docs: tuple[np.ndarray, np.ndarray] | None = None, at: np.ndarray | None = None) -> list[np.ndarray]:
    """Interpolated Kneser-Ney estimates of each row in both classes and in common over ``lower``, those of the order below.
    As far as the counts do not tell that a class differs, it has the common estimate, moved as the class is one order down.
    ``docs``: the documents of either class that hold each row, where the counts are not of documents. ``at``: where in
    ``lower`` the row's are. Rows are taken in blocks, so that the driver holds few arrays of all of them."""
    n, (context, places) = len(before), np.unique(before, return_inverse=True)
    places = places.astype(np.int32)
    told = docs or (toxic, ordinary)
    totals = [np.bincount(places, c, len(context)) for c in (toxic, ordinary, toxic + ordinary)]
    kinds = [np.bincount(places[c > 0], minlength=len(context)) for c in (toxic, ordinary, toxic + ordinary)]
    sums = [np.bincount(places, c, len(context)) for c in told]
    below = lambda k, s: lower[k][s if at is None else at[s]]
    share = np.empty(n, np.float32)
    for s in _blocks(n):
        a, b = sums[0][places[s]] * below(0, s), sums[1][places[s]] * below(1, s)
        share[s] = a / (a + b)
    own = _apart(*told, share)
    out = [np.empty(n, np.float32) for _ in range(3)]
    for s in _blocks(n):
        p, estimates = places[s], []
        for k, c in enumerate((toxic[s], ordinary[s], toxic[s] + ordinary[s])):
            total = totals[k][p]
            back = np.where(total > 0, DISCOUNT * kinds[k][p] / np.maximum(total, 1), 1.0)
            estimates.append(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1) + back * below(k, s))
        both_seen = (sums[0][p] > 0) & (sums[1][p] > 0)
        weight = np.where(both_seen, own[s], 0.0)
        for k in (0, 1):
            out[k][s] = weight * estimates[k] + (1 - weight) * estimates[2] * below(k, s) / below(2, s)
        out[2][s] = estimates[2]
    return out


def _log_ratio(estimates: list[np.ndarray]) -> np.ndarray:
    return np.log(estimates[0]) - np.log(estimates[1])


def fitted(bigrams: tuple[np.ndarray, ...], spelling: tuple[np.ndarray, ...], singles: tuple[np.ndarray, ...]) -> Model:
    """The model from (before, word or piece, toxic documents, ordinary documents) of bigrams, of pieces and of single words."""
    before, token, toxic, ordinary = bigrams
    word, places = np.unique(token, return_inverse=True)
    everywhere = np.zeros(len(word))  # a word's context one order down
    t1, o1 = (np.bincount(places, c > 0, len(word)).astype(float) for c in (toxic, ordinary))  # distinct words before it
    base = np.full(len(word), 1 / (len(word) + 1))
    order = np.argsort(singles[1])  # the same words, as each has a bigram
    single = _level(everywhere, t1, o1, [base] * 3, (singles[2][order], singles[3][order]))
    double = _level(before, toxic, ordinary, single, at=places)
    words = _table(word, _log_ratio(single))
    pairs = _table(pair_key(before, token), _log_ratio(double))

    before, piece, toxic, ordinary = spelling
    spelled = _level(before, toxic, ordinary, [np.full(len(piece), 1 / (len(piece) + 1))] * 3)
    return Model(pairs, words, _table(piece, _log_ratio(spelled)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic of one variable, slightly regularised."""
    scale = max(float(np.std(x)), 1e-9)
    z, w = x / scale, 1.0 / len(y)
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        r, h = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-4 * a, r.sum()])
        m = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return a / scale, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, toxic), at most ``sample`` of them."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    known = store.saved(known.orderBy(F.xxhash64("doc_id", F.lit(7)), "toxic").limit(sample), "labels")
    train = counts.joined_by_size(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), known, ["doc_id"], "inner")
    train = store.saved(train.select("doc_id", "toxic", "text"), "labelled").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(CALIBRATION)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, budget=SLICE_BYTES):
            words = text.words_of(piece.column(1), letters=True)
            toxic = piece.column(0).to_numpy()
            every = np.ones(len(words.doc), bool)
            before, token = stream(words)
            for kind, (before, now, alive) in [(0, (before, token, every)), (2, (np.zeros_like(token), token, every)), *((1, x) for x in pieces(words))]:
                before, now, doc = before[alive], now[alive], words.doc[alive]
                key = pair_key(before, now) if kind == 0 else now
                order = np.lexsort((key, doc))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(doc[order]) != 0) | (key[order][1:] != key[order][:-1])
                at = order[new]
                of, first, where = np.unique(key[at], return_index=True, return_inverse=True)
                by_class = [np.bincount(where, toxic[doc[at]] == k, len(of)).astype(np.int64) for k in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), kind)), text.as_i64(before[at][first]), text.as_i64(now[at][first]), *map(pa.array, by_class)], ["kind", "before", "piece", "t", "o"])

    share = train.agg(F.avg("toxic").alias("t"), F.expr("count_if(part != 0 AND toxic = 1)").alias("a"), F.expr("count_if(part != 0 AND toxic = 0)").alias("b"), F.expr("count_if(part = 0 AND toxic = 1)").alias("c"), F.expr("count_if(part = 0 AND toxic = 0)").alias("d")).collect()[0]
    if not all((share["a"], share["b"], share["c"], share["d"])):
        none = Table(np.zeros(0, np.uint64), np.zeros(0))
        return Model(none, none, none, constant=float(share["t"] or 0.0))
    seen = train.where("part != 0").select("toxic", "text").mapInArrow(count, "kind long, before long, piece long, t long, o long")
    rows = store.saved(seen.groupBy("kind", "before", "piece").agg(F.sum("t").cast("int").alias("t"), F.sum("o").cast("int").alias("o")), "ngrams")

    def collected(kind: int) -> tuple[np.ndarray, ...]:
        table = rows.where(F.col("kind") == kind).select("before", "piece", "t", "o").toArrow()
        return (*(table[c].to_numpy().view(np.uint64) for c in ("before", "piece")), *(table[c].to_numpy().astype(np.float32) for c in ("t", "o")))

    model = fitted(collected(0), collected(1), collected(2))
    text.give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, budget=SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(shared.value.means(piece.column(1)))], ["toxic", "x"])

    held = train.where("part = 0").select("toxic", "text").mapInArrow(measure, "toxic int, x double").toArrow()
    model.slope, model.offset = _logistic(np.arcsinh(held["x"].to_numpy() * 1000), held["toxic"].to_numpy().astype(float))
    return model


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != column)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text.slices(batches, budget=SLICE_BYTES):
            got = pa.array(shared.value.scores(piece.column("text")))
            yield pa.RecordBatch.from_arrays([*piece.columns, got], [*piece.schema.names, column])

    return docs.drop(column).mapInArrow(score, f"{fields}, `{column}` double")


def held_out(doc_id: str = "doc_id", folds: int = 5, at: int = 0):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == at, F.lit(False))
