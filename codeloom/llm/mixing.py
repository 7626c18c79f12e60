"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) take the weights in turn. Targets share all words by weight; none
exceeds ``max_repeat`` times its source's words, and the excess is shared again by weight. Within a source,
documents stand in the order of their size; each is expected ``target / source words`` times. The prefix sum
of expected copies, shifted by one random offset a source, crosses integers; each crossing emits a copy.

Cases: null or empty text has size 0 and takes 0 words; a source of no words has target 0; equal sizes are
ordered by ``doc_id``; repeated rows count as documents of their own; very long texts are one document each; no rows give
no rows; other columns are ignored, whatever their names (``emitted`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import counts, store

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
CELLS = 256  # a group of equal size in one source is ranked in so many parts
WORD = r"[^\x20\x09-\x0D]+"


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the source only."""
    digest = F.md5(F.concat(F.lit(seed + "/"), source))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source_key, source, source_size) -> the same with ``target``. One row a source."""
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    leveled = caps.withColumn("level", level).withColumn("n", F.row_number().over(by_ratio))
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("n", "level"))
    leveled = leveled.withColumn("first", F.min(free).over(everything))
    return leveled.select("source_key", "source", "source_size", F.least(F.col("cap"), F.col("first.level") * F.col("w")).alias("target"))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, its never-null key, and the words of each document."""
    return docs.select("doc_id", "source", _source_key().alias("source_key"), _size().alias("size"))


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """``measured`` rows -> doc_id, source_key, size, source_size, target, copies."""
    rows = rows.withColumn("cell", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(CELLS)))
    cells = rows.groupBy("source_key", "source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("source_key", "source", "size").agg(F.sum("n").alias("n_size"))
    sources = by_size.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n_size")).alias("source_size"))
    rates = targets(sources, weights, max_repeat).withColumn("shift", offset_of(F.col("source_key"), seed))
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).drop("source")
    earlier = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("source_key", "size", F.coalesce(F.sum("n_size").over(earlier), F.lit(0)).alias("before_size"))
    inside = Window.partitionBy("source_key", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source_key", "size", "cell", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before_cell"))
    places = cells.join(by_size, ["source_key", "size"]).join(rates, "source_key")
    in_cell = F.row_number().over(Window.partitionBy("source_key", "size", "cell").orderBy(F.col("doc_id").isNull(), "doc_id"))
    ranked = rows.select("doc_id", "source_key", "size", "cell", in_cell.alias("in_cell")).join(places, ["source_key", "size", "cell"])
    rank = F.col("before_size") + F.col("before_cell") + F.col("in_cell")
    crossed = F.floor(F.col("rate") * rank + F.col("shift")) - F.floor(F.col("rate") * (rank - 1) + F.col("shift"))
    return ranked.select("doc_id", "source_key", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def emitted(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    spark, keys = docs.sparkSession, ["doc_id", "source_key", "size"]
    names = store.fresh(docs, *keys, "nth", "copies", "copy")
    copies = store.saved(mixed(store.saved(measured(docs), "sizes"), weights, max_repeat, seed).select(*keys, "copies"), "copies")
    store.release(spark)
    whole = docs.withColumns({names[k]: c for k, c in zip(keys, (F.col("doc_id"), _source_key(), _size()), strict=True)})
    repeated = copies.groupBy(*keys).count().where("count > 1").limit(1).count()
    if repeated:  # rows alike in these are numbered on both sides, so that each has its own copies
        copies = copies.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("copies"))))
        whole = whole.withColumn(names["nth"], F.row_number().over(Window.partitionBy(*[names[k] for k in keys]).orderBy(F.xxhash64("text"))))
        keys = [*keys, "nth"]
    renamed = copies.where("copies > 0").select(*[F.col(k).alias(names[k]) for k in keys], F.col("copies").alias(names["copies"]))
    lowest = F.lit(-(2**63))
    whole, renamed = (d.withColumn(names["doc_id"], F.coalesce(names["doc_id"], lowest)) for d in (whole, renamed))
    taken = counts.joined_by_size(whole, renamed, [names[k] for k in keys], "inner")
    return taken.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), names["copies"]))).select(*docs.columns)


_CASE = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
_RATIO = "cap / w, source IS NULL, source"
#: The query in DuckDB SQL.
ORACLE = f"""
WITH s AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  ((coalesce(doc_id, 0) % {CELLS}) + {CELLS}) % {CELLS} AS cell FROM documents),
src AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1, 2),
wt AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} {_CASE} END)::DOUBLE AS w, source_size::DOUBLE * {MAX_REPEAT} AS cap FROM src),
lv AS (SELECT *, row_number() OVER (ORDER BY {_RATIO}) AS n,
  (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY {_RATIO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY {_RATIO} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM wt),
tg AS (SELECT k, source_size, least(cap, (SELECT lvl FROM lv WHERE lvl * w <= cap ORDER BY n LIMIT 1) * w) AS target FROM lv),
rt AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, ('0x' || substr(md5('{SEED}/' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS shift FROM tg),
rk AS (SELECT doc_id, k, size, row_number() OVER (PARTITION BY k ORDER BY size, cell, doc_id IS NULL, doc_id) AS r FROM s),
cp AS (SELECT doc_id, size, source_size, target, (floor(rate * r + shift) - floor(rate * (r - 1) + shift))::BIGINT AS copies FROM rk JOIN rt USING (k))
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM cp
"""
