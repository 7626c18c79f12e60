"""A Katz backoff model of order 3, learnt from and evaluated on whole corpora.

Tokens are words (A-Z lowered) and one end a document; two starts, which are context only, precede each document.
P(w | u v) is the Good-Turing discounted share d3(c) c / c(u v) where (u, v, w) was seen, else alpha(u v) P(w | v);
P(w | v) is d2(c) c / c(v) where (v, w) was seen, else alpha(v) P(w); P(w) is d1(c) c / N, and everything not in the
known types is one unknown type that gets the rest. alpha(h) = (1 - sum of discounted shares after h) / (1 - sum of
the lower order's probabilities of the same words), exactly, so each context sums to 1; an unseen context has 1.
Where the discounts leave nothing, c(h) is raised by one. All counts are kept and discounted, those of 1 too.

The table of n-grams is partitioned by the middle word v: a part holds all that P(w | u v) needs, the trigrams, the
bigrams (v, w) and the contexts. A word v that is more than one part's share of all tokens is dealt out by u to as
many parts as it needs; its bigrams are summed over these and given to each. A document's score is the sum of its
words' log P(w), which the parts of the words tell, and of what the contexts add, which the parts of the middle words
tell. The number of parts grows with the tokens (``PART_TOKENS``). Occurrences move as compressed arrays by part, once to be counted (each slice of documents
sums its own first) and once to be scored; a part returns a sum for each document. The ``HOT`` most frequent words
travel as ranks (a fixed number, broadcast), all others as hashes, whose counts are joined.

Cases: null and empty texts are one end token; repeated rows and ids and null ids count and are scored each (a null
id is not trained on nor held out); very long texts are one slice each; without training rows every token has P = 1;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, text

TOP = 5  # counts up to this are discounted
HOT = 1 << 19
PART_TOKENS = 1 << 20
SLICE_BYTES = 4 << 20
END, START = np.uint64(text.hash_bytes(b"\0end")), np.uint64(text.hash_bytes(b"\0start"))
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_COLD = np.uint64(1 << 63)  # marks a hash among ranks
TRIGRAMS, PAIRS, WORDS, ASKED, ASKED_WORDS, WHOLE = range(6)  # kinds of rows


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, compressed."""
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd"), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(-1))
        at += n * w
    return out


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, where each is first, and their sums of each of ``numbers``."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], order[at], *(np.add.reduceat(n[order], at) if len(at) else n[:0] for n in numbers)


def _found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    order = np.argsort(keys)  # ascending keys are found with fewer cache misses
    at = np.empty(len(keys), np.int64)
    at[order] = np.minimum(np.searchsorted(table, keys[order]), len(table) - 1)
    return at, table[at] == keys


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return text.mix(a * _A + b * _B)


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return text.mix(u * _A + v * _B + w * _C)


def discounts(histogram: list[int]) -> list[float]:
    """Good-Turing factors of the counts 0 .. TOP (index). Where the counts of counts are too thin, 1 - 0.5 / r."""
    n = [0, *histogram]
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    out = [0.0] * (TOP + 1)
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else -1.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def _histogram(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].astype(np.int64)


@dataclass
class Vocabulary:
    """The most frequent words and the start: sorted hashes with ranks; by rank: counts, and how many parts a middle word has."""

    keys: np.ndarray
    ranks: np.ndarray
    n: np.ndarray
    dealt: np.ndarray
    parts: int
    least: int  # as frequent, by 8 log2 of the count, are the words here

    def coded(self, words: text.Words) -> tuple[np.ndarray, ...]:
        """By token: document, code of the word two before, one before, itself; hashes of the codes beyond the ranks."""
        n_docs = words.n_docs
        token = np.insert(words.hashes(), words.doc_word[1:], END)
        starts = words.doc_word[:-1] + np.arange(n_docs)
        doc = np.repeat(np.arange(n_docs), np.diff(words.doc_word) + 1)
        some, back = np.unique(token, return_inverse=True)
        at, hit = _found(some, self.keys)
        code = np.where(hit, self.ranks[at], 0).astype(np.int64)
        hit &= some != START
        code[~hit] = len(self.n) + np.arange((~hit).sum())
        w = code[back]
        v = np.concatenate([w[:1], w[:-1]])
        v[starts] = 0
        u = np.concatenate([v[:1], v[:-1]])
        u[starts] = 0
        return doc, u, v, w, some[~hit]

    def part(self, u: np.ndarray, v: np.ndarray, cold: np.ndarray) -> np.ndarray:
        """The part of each context, from codes."""
        own = text.mix(np.concatenate([np.arange(len(self.n), dtype=np.uint64), cold | _COLD]) ^ _C)
        many = np.concatenate([self.dealt, np.ones(len(cold), np.int64)])
        to = own[v] % np.uint64(self.parts)
        cut = np.flatnonzero(many[v] > 1)
        to[cut] += text.mix(own[u[cut]]) % many[v[cut]].astype(np.uint64)
        return (to % np.uint64(self.parts)).astype(np.int64)

    def own(self, word: np.ndarray) -> np.ndarray:
        """The part that holds the count of a word without a rank."""
        return (text.mix(word ^ _C) % np.uint64(self.parts)).astype(np.int64)

    def places(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th part of a middle word given by its rank."""
        return ((text.mix(word ^ _C) % np.uint64(self.parts) + k.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def sent(self, cold: np.ndarray, *codes: np.ndarray) -> tuple[bytes, tuple[np.ndarray, ...]]:
        """The hashes that ``codes`` need, and the codes with places among these instead."""
        base = len(self.n)
        far = [np.flatnonzero(c >= base) for c in codes]
        used = np.unique(np.concatenate([c[f] for c, f in zip(codes, far, strict=True)]))
        out = tuple(c.astype("<u4") for c in codes)
        for c, o, f in zip(codes, out, far, strict=True):
            o[f] = base + np.searchsorted(used, c[f])
        return cold[used - base].tobytes(), out

    def words(self, hashes: bytes, *codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ranks, or marked hashes."""
        every = np.frombuffer(hashes, "<u8") | _COLD
        out = []
        for c in codes:
            far = np.flatnonzero(c >= len(self.n))
            word = c.astype(np.uint64)
            word[far] = every[c[far] - len(self.n)]
            out.append(word)
        return tuple(out)


@dataclass
class Model:
    """trigrams (part, blob), bucketed by part; given (part, kind, a, b, n): bigrams of words dealt to many parts, counts of words
    without a rank; and numbers."""

    trigrams: DataFrame
    given: DataFrame
    vocabulary: Broadcast
    train_tokens: int
    n_types: int
    factors: list[list[float]]  # of words, bigrams, trigrams
    word_total: float
    unknown: float  # P of the unknown type


def counted(docs: DataFrame) -> DataFrame:
    """key, n of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for piece in text.slices(batches, budget=SLICE_BYTES):
            words = text.words_of(piece.column(0), lower=True)
            key, n = np.unique(words.hashes(), return_counts=True)
            keys += [key, np.array([END])]
            counts += [n, np.array([words.n_docs])]
            held += len(key)
            if held > 1 << 20:
                key, _, n = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [key], [n], 0
                if len(key) > 1 << 19:
                    yield pa.RecordBatch.from_arrays([text.as_i64(key), pa.array(n)], ["key", "n"])
                    keys, counts = [], []
        if keys:
            key, _, n = _summed(np.concatenate(keys), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([text.as_i64(key), pa.array(n)], ["key", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def _level():
    return F.floor(F.log2("n") * 8).cast("int")


def vocabulary(words: DataFrame, n_tokens: int, hot: int, part_tokens: int) -> Vocabulary:
    level = _level()
    levels = sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True)
    least, have = 1 << 10, 0
    for r in levels:
        have += r["c"]
        if have > hot:
            break
        least = r["level"]
    rows = words.where(level >= least).toArrow()
    key, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.lexsort((key, -n))
    key, n = np.concatenate([[START], key[order]]).astype(np.uint64), np.concatenate([[0], n[order]]).astype(np.int64)
    parts = max(1, -(-n_tokens // part_tokens))
    as_context = n.copy()
    as_context[0] = n[key == END].sum()  # there are as many starts as ends
    by_key = np.argsort(key)
    return Vocabulary(key[by_key], by_key.astype(np.int64), n, np.minimum(np.maximum(-(-as_context // part_tokens), 1), parts), parts, least)


_ROWS = "part long, kind long, a long, b long, n long, blob binary, histograms array<long>"


def _row_batch(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64())]
    names = ["part", "kind", "a", "b", "n", "blob", "histograms"]
    return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})


def _as_rows(column: str, kinds: tuple[str, ...], names: list[str]):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = unpack(blob, *kinds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got[0]), part)), *(text.as_i64(g) for g in got)], names)

    return spread


def fit(docs: DataFrame, hot: int = HOT, part_tokens: int = PART_TOKENS) -> Model:
    spark = docs.sparkSession
    words = store.saved(counted(docs), "lm-words")
    store.release(spark)
    seen = words.agg(F.sum("n"), F.count(F.lit(1)), *[F.expr(f"count_if(n = {r})") for r in range(1, TOP + 2)]).collect()[0]
    n_tokens, n_types = int(seen[0] or 0), int(seen[1])
    d1 = discounts([int(x) for x in seen[2:]])
    kept = words.agg(F.sum(_kept(d1))).collect()[0][0] or 0.0
    word_total = float(n_tokens + (kept >= n_tokens - 1e-9))
    shared = spark.sparkContext.broadcast(vocabulary(words, n_tokens, hot, part_tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for piece in text.slices(batches, budget=SLICE_BYTES):
            _, u, v, w, cold = vocab.coded(text.words_of(piece.column(0), lower=True))
            part = vocab.part(u, v, cold)
            # equal trigrams stand together, but for a few that share 32 bits: these are summed by the part
            near = (text.mix(u.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) | (v & 0xFFFFF) << 32
            order = np.argsort(part << 52 | near) if vocab.parts <= 1 << 11 else np.lexsort((near, part))
            part, u, v, w = (x[order] for x in (part, u, v, w))
            at = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
            n = np.diff(np.append(at, len(order))).astype("<u4")
            part, u, v, w = (x[at] for x in (part, u, v, w))
            out = []
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                if len(run):
                    hashes, codes = vocab.sent(cold, u[run], v[run], w[run])
                    out.append((int(part[run[0]]), hashes, pack(*codes, n[run])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["part", "hashes", "blob"])

    def merge(group: pa.Table) -> pa.Table:
        vocab, part, got = shared.value, group["part"][0].as_py(), []
        for hashes, blob in zip(group["hashes"].to_pylist(), group["blob"].to_pylist(), strict=True):
            *codes, n = unpack(blob, "<u4", "<u4", "<u4", "<u4")
            got.append((*vocab.words(hashes, *codes), n.astype(np.int64)))
        u, v, w, n = (np.concatenate(x) for x in zip(*got, strict=True))
        _, first, total = _summed(triple_key(u, v, w), n)
        order = np.argsort((v[first] & np.uint64(0xFFFFFF)) << np.uint64(24) | u[first] & np.uint64(0xFFFFFF))
        u, v, w, total = (x[order] for x in (u[first], v[first], w[first], total))
        cut = vocab.dealt[np.where(v < _COLD, v, 0).astype(np.int64)] > 1
        cut &= v < _COLD
        _, first, n = _summed(pair_key(v, w), total)
        whole = ~cut[first]
        rows = [(part, TRIGRAMS, 0, 0, 0, pack(u, v, w, total), np.concatenate([_histogram(n[whole]), _histogram(total)]).tolist())]
        if cut.any():
            rows.append((part, PAIRS, 0, 0, 0, pack(v[first[~whole]], w[first[~whole]], n[~whole]), None))
        cold = np.unique(w[w >= _COLD])
        if len(cold):
            rows.append((part, WORDS, 0, 0, 0, pack(cold), None))
        del u, v, w, total, first, n, order
        text.give_back()
        return _row_batch(rows)

    sent = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "part long, hashes binary, blob binary")
    table = store.bucketed(sent.groupBy("part").applyInArrow(merge, _ROWS), "lm_trigrams", "part", shared.value.parts)
    store.release(spark)
    some = table.where(F.col("kind") == PAIRS).select("part", "blob").mapInArrow(_as_rows("blob", ("<u8", "<u8", "<i8"), ["part", "a", "b", "n"]), "part long, a long, b long, n long")
    pairs = store.saved(some.groupBy("a", "b").agg(F.sum("n").alias("n")), "lm-pairs")
    told = table.where(F.col("kind") == TRIGRAMS).agg(*[F.sum(F.col("histograms")[i]) for i in range(2 * TOP + 2)]).collect()[0]
    more = pairs.agg(*[F.expr(f"count_if(n = {r})") for r in range(1, TOP + 2)]).collect()[0]
    d2 = discounts([int(x or 0) + int(y) for x, y in zip(told[: TOP + 1], more, strict=True)])
    d3 = discounts([int(x or 0) for x in told[TOP + 1 :]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            many = vocab.dealt[v.astype(np.int64)]
            row = np.repeat(np.arange(len(v)), many)
            k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(vocab.places(v[row], k)), *(c.take(pa.array(row)) for c in batch.columns)], ["part", "a", "b", "n"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0).to_numpy().view(np.uint64) | _COLD
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.own(word)), text.as_i64(word), batch.column(1)], ["part", "a", "n"])

    needed = table.where(F.col("kind") == WORDS).select("part", "blob").mapInArrow(_as_rows("blob", ("<u8",), ["part", "a"]), "part long, a long")
    given = pairs.mapInArrow(deal, "part long, a long, b long, n long")
    needed = needed.union(given.where("b < 0").select("part", "b"))  # hashes are marked by the sign
    cold = needed.join(words.select(F.col("key").bitwiseOR(F.lit(-(2**63))).alias("a"), "n"), "a")
    given = given.select("part", F.lit(PAIRS).cast("long").alias("kind"), "a", "b", "n")
    rows = [cold.select("part", "a", "n"), words.where(_level() < shared.value.least).select("key", "n").mapInArrow(keep, "part long, a long, n long")]
    for more in rows:
        given = given.union(more.select("part", F.lit(WORDS).cast("long"), "a", F.lit(0).cast("long"), "n"))
    given = store.saved(given, "lm-given")
    store.release(spark)
    return Model(table.where(F.col("kind") == TRIGRAMS).select("part", "blob"), given, shared, n_tokens, n_types, [d1, d2, d3], word_total, 1.0 - kept / word_total if n_tokens else 1.0)


def _kept(factors: list[float]):
    factor = F.element_at(F.array(*[F.lit(x) for x in factors]), (F.least("n", F.lit(TOP)) + 1).cast("int"))
    return F.when(F.col("n") > TOP, F.lit(1.0)).otherwise(factor) * F.col("n")


def _discounted(n: np.ndarray, factors: list[float]) -> np.ndarray:
    return np.where(n > TOP, 1.0, np.array(factors)[np.minimum(n, TOP)]) * n


def _word_p(n: np.ndarray, numbers: tuple) -> np.ndarray:
    """P of words by their counts."""
    factors, total, unknown = numbers
    return np.where(n > 0, _discounted(n, factors[0]) / max(total, 1.0), unknown)


class _Part:
    """One part of the table, with its backoff weights."""

    def __init__(self, trigrams: list[bytes], given: pa.Table, vocab: Vocabulary, model: tuple) -> None:
        self.vocab = vocab
        self.numbers = model
        kind, a, b, n = (given[c].to_numpy() for c in ("kind", "a", "b", "n"))
        at = np.flatnonzero(kind == WORDS)
        self.cold, first = np.unique(a[at].view(np.uint64), return_index=True)
        self.cold_n = n[at[first]]
        got = [unpack(x, "<u8", "<u8", "<u8", "<i8") for x in trigrams]
        u, v, w, c = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (*[np.zeros(0, np.uint64)] * 3, np.zeros(0, np.int64))
        # bigrams: summed here, or given where the middle word is dealt to many parts
        whole = (v >= _COLD) | (vocab.dealt[np.where(v < _COLD, v, 0).astype(np.int64)] == 1)
        _, first, n2 = _summed(pair_key(v[whole], w[whole]), c[whole])
        at = kind == PAIRS
        bv, bw, bn = np.concatenate([v[whole][first], a[at].view(np.uint64)]), np.concatenate([w[whole][first], b[at].view(np.uint64)]), np.concatenate([n2, n[at]])
        kept = _discounted(bn, model[0][1])
        self.v, _, total, kept_all, p_all = _summed(bv, bn, kept, self.word_p(bw))
        total = total + (kept_all >= total - 1e-9)
        self.v_alpha = np.log10((1 - kept_all / total) / (1 - p_all))
        p2 = kept / total[np.searchsorted(self.v, bv)]
        keys = pair_key(bv, bw)
        order = np.argsort(keys)
        self.vw, p2 = keys[order], p2[order]
        self.vw_p = np.log10(p2)
        del bv, bw, bn, keys, order, first, n2, whole
        kept = _discounted(c, model[0][2])
        keys = pair_key(u, v)
        lower = p2[_found(pair_key(v, w), self.vw)[0]] if len(v) else np.zeros(0)
        self.uv, _, total, kept_all, p_all = _summed(keys, c, kept, lower)
        total = total + (kept_all >= total - 1e-9)
        self.uv_alpha = np.log10((1 - kept_all / total) / (1 - p_all))
        p3 = np.log10(kept / total[np.searchsorted(self.uv, keys)]) if len(keys) else np.zeros(0)
        keys = triple_key(u, v, w)
        order = np.argsort(keys)
        self.uvw, self.uvw_p = keys[order], p3[order]

    def count(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(w), np.int64)
        far = w >= _COLD
        out[~far] = self.vocab.n[w[~far].astype(np.int64)]
        at, hit = _found(w[far], self.cold)
        out[far] = np.where(hit, self.cold_n[at] if len(self.cold_n) else 0, 0)
        return out

    def word_p(self, w: np.ndarray) -> np.ndarray:
        return _word_p(self.count(w), self.numbers)

    def gain(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | u v) - log10 P(w). P(w) is asked for where (v, w) was seen only, so the part knows the count of w."""
        at, hit = _found(triple_key(u, v, w), self.uvw)
        out = np.zeros(len(w))
        out[hit] = self.uvw_p[at[hit]] - np.log10(self.word_p(w[hit]))
        rest = np.flatnonzero(~hit)
        at, hit = _found(pair_key(u[rest], v[rest]), self.uv)
        out[rest[hit]] = self.uv_alpha[at[hit]]
        at, hit = _found(pair_key(v[rest], w[rest]), self.vw)
        out[rest[hit]] += self.vw_p[at[hit]] - np.log10(self.word_p(w[rest[hit]]))
        rest = rest[~hit]
        at, hit = _found(v[rest], self.v)
        out[rest[hit]] += self.v_alpha[at[hit]]
        return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""
    shared = model.vocabulary
    base_total = float(model.train_tokens + model.n_types + 1)
    numbers = (model.factors, model.word_total, model.unknown)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        base = np.log10((vocab.n + 1) / base_total)
        ranked = len(vocab.n)
        own = np.log10(_word_p(vocab.n, numbers))
        for k, piece in enumerate(text.slices(batches, budget=SLICE_BYTES)):
            doc, u, v, w, cold = vocab.coded(text.words_of(piece.column(1), lower=True))
            n_docs = piece.num_rows
            near = w < ranked
            sums = [np.bincount(doc, minlength=n_docs).astype(float), np.bincount(doc[near], vocab.n[w[near]] > 0, n_docs), np.bincount(doc[near], base[w[near]], n_docs), np.bincount(doc[near], own[w[near]], n_docs)]
            slice_ = TaskContext.get().partitionId() << 32 | k
            ids = piece.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            out = [(slice_ % vocab.parts, slice_, WHOLE, b"", pack(ids.fill_null(0).to_numpy(), known, *sums))]
            far = np.flatnonzero(~near)
            part = vocab.own(cold | _COLD)[w[far] - ranked]
            order = np.argsort(part, kind="stable")
            for run in np.split(far[order], np.flatnonzero(np.diff(part[order])) + 1):
                if len(run):
                    hashes, (code,) = vocab.sent(cold, w[run])
                    out.append((int(vocab.own(np.array([cold[w[run[0]] - ranked] | _COLD]))[0]), slice_, ASKED_WORDS, hashes, pack(doc[run].astype("<u4"), code)))
            part = vocab.part(u, v, cold)
            order = np.argsort(part.astype(np.uint16) if vocab.parts <= 1 << 16 else part, kind="stable")
            part, doc, u, v, w = (x[order] for x in (part, doc, u, v, w))
            # a text that repeats itself sends the same row again and again: once, with its number
            at = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0) | (np.diff(u, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0))
            n = np.diff(np.append(at, len(order))).astype("<u4")
            part, doc, u, v, w = (x[at] for x in (part, doc, u, v, w))
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                if len(run):
                    hashes, codes = vocab.sent(cold, u[run], v[run], w[run])
                    out.append((int(part[run[0]]), slice_, ASKED, hashes, pack(np.diff(doc[run], prepend=0).astype("<u4"), *codes, n[run])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["part", "slice", "kind", "hashes", "blob"])

    def answer(table: pa.Table, sent: pa.Table) -> pa.Table:
        vocab = shared.value
        kinds = sent["kind"].to_numpy()
        part = _Part(table["blob"].to_pylist(), sent.filter(pa.array((kinds == PAIRS) | (kinds == WORDS))), vocab, numbers)
        sent = sent.filter(pa.array(kinds >= ASKED))
        slices, wholes, blobs = [], [], []
        for slice_, kind, hashes, blob in zip(*(sent[c].to_pylist() for c in ("slice", "kind", "hashes", "blob")), strict=True):
            if kind == ASKED:
                doc, *codes, n = unpack(blob, "<u4", "<u4", "<u4", "<u4", "<u4")
                of, where = np.unique(np.cumsum(doc), return_inverse=True)
                gain = np.bincount(where, n * part.gain(*vocab.words(hashes, *codes)), len(of))
                blob = pack(of.astype("<u4"), np.zeros(len(of)), np.zeros(len(of)), gain)
            elif kind == ASKED_WORDS:
                doc, code = unpack(blob, "<u4", "<u4")
                n = part.count(vocab.words(hashes, code)[0])
                of, where = np.unique(doc, return_inverse=True)
                sums = (n > 0, np.log10((n + 1) / base_total), np.log10(_word_p(n, numbers)))
                blob = pack(of, *(np.bincount(where, x, len(of)).astype(float) for x in sums))
            slices.append(slice_)
            wholes.append(kind == WHOLE)
            blobs.append(blob)
        del part
        text.give_back()
        return pa.table({"slice": pa.array(slices, pa.int64()), "whole": pa.array(wholes, pa.bool_()), "blob": pa.array(blobs, pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        whole, blobs = group["whole"].to_pylist(), group["blob"].to_pylist()
        ids, known, n_tokens, *sums = unpack(blobs[whole.index(True)], "<i8", "u1", "<f8", "<f8", "<f8", "<f8")
        sums = [s.copy() for s in sums]
        for is_whole, blob in zip(whole, blobs, strict=True):
            if not is_whole:
                of, *parts = unpack(blob, "<u4", "<f8", "<f8", "<f8")
                for s, p in zip(sums, parts, strict=True):
                    s[of] += p
        n = [np.rint(x).astype(np.int64) for x in (n_tokens, sums[0])]
        return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n_tokens": pa.array(n[0]), "n_known": pa.array(n[1]), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    sent = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(send, "part long, slice long, kind long, hashes binary, blob binary")
    nothing = F.lit(None)
    asked = sent.select("part", "slice", "kind", "hashes", "blob", *[nothing.cast("long").alias(c) for c in "abn"])
    asked = asked.union(model.given.select("part", nothing.cast("long"), "kind", nothing.cast("binary"), nothing.cast("binary"), "a", "b", "n"))
    answers = model.trigrams.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "slice long, whole boolean, blob binary")
    return answers.groupBy("slice").applyInArrow(add, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(folds: int = 7, at: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == at, F.lit(False))


def trained_on(folds: int = 7, at: int = 2):
    """The rows to learn from; a null id is neither learnt from nor held out."""
    return F.col("doc_id").isNotNull() & ~held_out(folds, at)
