"""Collocations: frequent phrases of each language whose words stand together more often than their parts would.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A first pass adds
up every phrase of up to ``words`` words in count-min sketches, one a task, which are merged; a cell never counts too little, so a
phrase whose cells all reach ``least`` may be frequent and any other isn't. A second pass counts those exactly: words are numbered
within a slice of texts by their bytes, phrases by pairs of numbers, so no hash decides what is equal. Parts of a frequent phrase are
frequent too, so the same pass counts them. Then each cut of a phrase is scored, contained phrases are subsumed by longer ones, and
counts by ranges of scores tell which ranges hold the best of each language, so that no task sorts a language.

A sketch has a cell a word of the corpus in each of ``DEPTH`` rows, within ``WIDTHS``, as a task holds it whole. A corpus of far more
phrases than cells fills it: more phrases are then counted exactly that turn out rare, and the result stays the same.

Cases: a null text is an empty one; a null language is ``und``; documents without words give nothing; null ids, repeated rows and
extra columns don't matter, each row counts; very long texts are taken whole; no rows give no rows. Ties of cuts go to the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store, text

WORDS, LEAST, MOST = 3, 10, 2000
SHARE = 50  # percent of a phrase that a longer one has to have to stand for it
DEPTH, WIDTHS = 2, (1 << 20, 1 << 25)
SLICE_BYTES = 2 << 20
COUNTS = "lang string, words int, phrase binary, a long"

_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Phrases:
    """The words of a slice of texts, and the runs of up to ``words`` of them that lie in one piece."""

    def __init__(self, batch: pa.RecordBatch, words: int) -> None:
        buf, at = text.bytes_of(batch.column(0))
        buf = _LOWER[buf]
        solid = ~_APART[buf]
        lead = np.ones(len(buf) + 1, bool)
        lead[1:-1] = ~solid[:-1]
        lead[at] = True
        self.start = np.flatnonzero(solid & lead[:-1])
        tail = np.ones(len(buf), bool)
        if len(buf):
            tail[:-1] = lead[1:-1] | ~solid[1:]
        self.end = np.flatnonzero(solid & tail) + 1
        self.buf, self.words = buf, words
        doc = np.searchsorted(at, self.start, side="right") - 1
        pieces = np.cumsum(_BREAK[buf])
        piece = pieces[self.start] if len(self.start) else np.zeros(0, np.int64)
        joined = np.zeros(len(self.start), bool)  # with the word before
        joined[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        run = np.arange(len(joined)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(joined)))) if len(joined) else np.zeros(0, np.int64)
        self.before = run  # words before this one in its piece
        langs = pc.fill_null(batch.column(1), "und").dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.lang = np.asarray(langs.indices)[doc].astype(np.int64)

    def ends(self, k: int) -> np.ndarray:
        """The last word of each phrase of ``k`` words."""
        return np.flatnonzero(self.before >= k - 1)

    def hashes(self, k: int) -> np.ndarray:
        """By last word; of phrases of ``k`` words and their language."""
        if not hasattr(self, "_hash"):
            w = text.Words(self.buf, np.array([0, len(self.buf)]), self.start, self.end, np.zeros(0, np.int64), np.array([0, len(self.start)]))
            self._hash = w.hashes()
            self._lang = np.array([text.hash_bytes(n.encode()) for n in self.names], np.uint64)
        last = self.ends(k)
        out = self._lang[self.lang[last]] + np.uint64(k)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = text.mix(out * np.uint64(0x9E3779B97F4A7C15) + self._hash[last - j])
        return out

    def numbers(self) -> np.ndarray:
        """Equal numbers for equal words of equal languages."""
        sizes = self.end - self.start
        inside = np.zeros(len(self.buf) + 1, np.int8)
        np.add.at(inside, self.start, 1)
        np.add.at(inside, self.end, -1)
        packed = self.buf[np.cumsum(inside[:-1]) > 0]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(packed)])
        word = np.asarray(column.dictionary_encode().indices).astype(np.int64)
        return np.unique(self.lang * (word.max(initial=0) + 1) + word, return_inverse=True)[1].reshape(-1)


def _cells(hashes: np.ndarray, depth: int, width: int) -> Iterator[np.ndarray]:
    for row in range(depth):
        yield row * width + (text.mix(hashes + np.uint64(0xA0761D6478BD642F * (row + 1) % (1 << 64))) & np.uint64(width - 1)).astype(np.int64)


def width_for(docs: DataFrame) -> int:
    """Cells of a row: a power of two, about one for six bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return min(max(WIDTHS[0], 1 << (size // 6).bit_length()), WIDTHS[1])


def sketched(docs: DataFrame, words: int, least: int, width: int, depth: int) -> np.ndarray:
    """A bit a cell: whether the merged count-min sketch has ``least`` there. Cells stop at ``least``, so a task sends few bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        cells = np.zeros(depth * width, np.uint8 if least < 128 else np.uint32)  # no cell counts beyond ``least``
        for part in text.slices(batches, budget=SLICE_BYTES):
            p = Phrases(part, words)
            for k in range(1, words + 1):
                for at in _cells(p.hashes(k), depth, width):
                    which, n = np.unique(at, return_counts=True)
                    cells[which] = np.minimum(cells[which] + np.minimum(n, least).astype(cells.dtype), least)
        return cells

    kind = "u1" if least < 128 else "u4"
    docs = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)  # each task sends a sketch
    full = store.merged_arrays(docs, make, lambda a, b: np.minimum(a + b, least), depth * width, kind, "u4", 64, finish=lambda x: (x >= least).astype(np.uint8))
    return np.packbits(full)


def survivors(docs: DataFrame, bits: Broadcast, words: int, width: int, depth: int) -> DataFrame:
    """Counts by slice of the phrases that the sketch lets pass, and of all words (``words`` 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = bits.value
        for part in text.slices(batches, budget=SLICE_BYTES):
            p = Phrases(part, words)
            langs, sizes, phrases, counts = [], [], [], []
            for lang, n in zip(*np.unique(p.lang, return_counts=True), strict=True):
                langs.append(p.names[lang])
                sizes.append(0)
                phrases.append(b"")
                counts.append(int(n))
            raw, number = p.buf.tobytes(), p.numbers()
            key = number.copy()
            for k in range(1, words + 1):
                last = p.ends(k)
                if not len(last):
                    break
                if k > 1:  # a phrase is the pair of the one without its last word and that word
                    pair = np.zeros(len(number), np.int64)
                    pair[last] = np.unique(key[last - 1] * (number.max() + 1) + number[last], return_inverse=True)[1].reshape(-1)
                    key = pair
                passed = np.ones(len(last), bool)
                for at in _cells(p.hashes(k), depth, width):
                    passed &= (full[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) > 0
                last = last[passed]
                _, first, n = np.unique(key[last], return_index=True, return_counts=True)
                last = last[first]
                starts, ends = p.start[last[:, None] - np.arange(k)[::-1]], p.end[last[:, None] - np.arange(k)[::-1]]
                phrases += [b" ".join([raw[a:b] for a, b in zip(s, e, strict=True)]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                langs += [p.names[x] for x in p.lang[last]]
                sizes += [k] * len(last)
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "words", "phrase", "a"])

    return docs.mapInArrow(count, COUNTS)


def counted(docs: DataFrame, words: int = WORDS, least: int = LEAST, width: int | None = None, depth: int = DEPTH) -> DataFrame:
    """lang, words, phrase, a: the exact count of every phrase of 1 to ``words`` words that occurs ``least`` times, and of all
    words of a language (``words`` 0). A table."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    width = width or width_for(docs)
    bits = docs.sparkSession.sparkContext.broadcast(sketched(docs, words, least, width, depth))
    sums = survivors(docs, bits, words, width, depth).groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))
    out = store.saved(sums.where((F.col("a") >= least) | (F.col("words") == 0)).withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    bits.destroy()
    return out


def _looked_up(rows: DataFrame, heavy: DataFrame, light: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of their ``part``: parts that may begin or end very many phrases come by broadcast, so that the join by
    shuffle has few rows of each."""
    table = lambda counts: counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    tried = rows.join(F.broadcast(table(heavy)), ["lang", part], "left")
    return tried.where(F.col(name).isNotNull()).unionByName(tried.where(F.col(name).isNull()).drop(name).join(table(light), ["lang", part])).drop(part)


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, a, l, r, score of each candidate: its lowest-scoring cut. Decimals of 38 digits hold the products."""
    candidates = counts.where("words >= 2")
    total = counts.where("words = 0").agg(F.sum("a")).collect()[0][0] or 0
    bound = max(least * 1000, total >> 16)  # at most 2^16 phrases of each length count more; a part that counts a is in a / least candidates
    heavy, light = counts.where((F.col("words") > 0) & (F.col("a") > bound)), counts.where((F.col("words") > 0) & (F.col("a") <= bound))
    tokens = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"_first": F.array_join(F.slice(tokens, F.lit(1), F.col("k")), " "), "_rest": F.array_join(F.slice(tokens, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    cuts = _looked_up(_looked_up(cuts, heavy, light, "_first", "l"), heavy, light, "_rest", "r")
    d = "cast({} AS decimal(18,0))".format
    cuts = cuts.withColumn("score", F.expr(f"({d('1000000')} * {d('a')} * {d('a')}) div ({d('l')} * {d('r')})"))
    best = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    return best.select("lang", "words", "phrase", "a", "_b.l", "_b.r", "_b.score")


def subsumed(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase: candidates whose words lie in a longer one that has ``share`` percent of their count."""
    longer = counts.where("words >= 3").select("lang", "words", F.split("phrase", " ").alias("t"), F.col("a").alias("longer"))
    sizes = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    inner = sizes.select("lang", "longer", F.explode(F.expr("transform(sequence(1, words - k + 1), i -> array_join(slice(t, i, k), ' '))")).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return counts.where("words >= 2").join(most, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("a") * share).select("lang", "phrase")


def _last_range(rows: DataFrame, by: str, ahead: Column, most: int, carried: list[str] | None = None) -> DataFrame:
    """lang, ``_last<by>`` and ``_ahead<by>``: the lowest range that begins within the ``most`` highest rows, of which ``ahead`` stand
    outside, and how many rows are before it."""
    keys = ["lang", *(carried or [])]
    sizes = rows.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("lang").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1))
    inside = sizes.withColumn("_above", F.coalesce(above, F.lit(0)) + ahead).where(F.col("_above") < most)
    return inside.groupBy(*keys).agg(F.min(by).alias(f"_last{by}"), F.max("_above").alias(f"_ahead{by}"))


def mined(docs: DataFrame, words: int = WORDS, least: int = LEAST, most: int = MOST, share: int = SHARE, width: int | None = None, depth: int = DEPTH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language by score, count and bytes."""
    counts = counted(docs, words, least, width, depth)
    left = store.saved(scored(counts, least).join(subsumed(counts, share), ["lang", "phrase"], "left_anti"), "scored")
    # how many stand in each range of scores tells which range holds the last of the best; within it, each score and range of counts.
    # Ranges go up as the order does, so that no row of a lower one comes before a row of a higher one
    left = left.withColumns({"_range": F.expr("score div 1000"), "_fine": F.struct("score", F.floor(F.log2("a")).alias("a"))})
    last = _last_range(left, "_range", F.lit(0), most)
    near = left.join(F.broadcast(last), "lang").where(F.col("_range") >= F.col("_last_range"))  # a row a language
    fine = _last_range(near.where(F.col("_range") == F.col("_last_range")), "_fine", F.col("_ahead_range"), most, ["_ahead_range"])
    some = near.join(F.broadcast(fine.drop("_ahead_range")), "lang").where((F.col("_range") > F.col("_last_range")) | (F.col("_fine") >= F.col("_last_fine")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    total = F.broadcast(counts.where("words = 0").select("lang", F.col("a").alias("n")))  # a row a language
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS t FROM p),
totals AS (SELECT lang, sum(len(t))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, 1 AS words, unnest(t) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM w WHERE len(t) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM w WHERE len(t) >= 3),
f AS (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS t FROM f WHERE words >= 2),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (SELECT k.lang, k.words, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ((1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.t[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.t[k.k + 1:k.words], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s) WHERE place = 1),
i AS (SELECT lang, array_to_string(t[1:2], ' ') AS phrase, a AS longer FROM c WHERE words = 3 UNION ALL SELECT lang, array_to_string(t[2:3], ' '), a FROM c WHERE words = 3),
o AS (SELECT b.lang, b.phrase FROM b JOIN (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY 1, 2) m ON m.lang = b.lang AND m.phrase = b.phrase WHERE 100 * longer >= 50 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase))
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN totals USING (lang) WHERE rank <= 2000
"""
