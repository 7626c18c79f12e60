"""An index of intervals by dyadic bins, so that points meet only intervals that hold them.

An interval of whole numbers is cut into the fewest blocks of the form [i 2^k, (i + 1) 2^k): two a level at most, disjoint, and level by
level as in a segment tree. A point lies in one block a level. So (key, level, block) is an equi-join whose rows are the hits and nothing
else, and the intervals of one hot key are dealt out by their blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import saved

LEVELS = 62
HITS, PIECES = 1 << 24, 8  # pairs that one task makes, of pieces of an eighth of that at most
TASKS = 10_000


def _level(length: Column) -> Column:
    """The largest k with 2^k <= length."""
    return F.length(F.conv(length.cast("string"), 10, 2)) - 1


def blocks(start: Column, end: Column) -> Column:
    """array of (level, block): the fewest dyadic blocks that make up start to end, both included; null or empty intervals have none."""
    first, after = start.cast("long"), end.cast("long") + 1

    def at_level(k: Column) -> Column:
        low = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)  # rounded up
        high = F.call_function("shiftright", after, k)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        some = low < high
        block = lambda x: F.struct(k.alias("level"), x.alias("block"))
        return F.array(F.when(some & odd(low), block(low)), F.when(some & odd(high), block(high - 1)))

    every = F.flatten(F.transform(F.sequence(F.lit(0), _level(after - first)), at_level))
    return F.when(after > first, F.filter(every, lambda b: b.isNotNull()))


def _cut(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """A row a block of each interval."""
    cut = intervals.select("*", F.explode(blocks(F.col(start), F.col(end))).alias("_b"))
    return cut.select("*", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).drop("_b")


def _levelled(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """A row of each point for each level that an interval can have."""
    top = intervals.agg(F.coalesce(F.least(F.max(_level(F.greatest(F.col(end).cast("long") - F.col(start) + 1, F.lit(1)))), F.lit(LEVELS)), F.lit(0)).alias("top"))
    levelled = points.where(F.col(at).isNotNull()).withColumn("_top", top.scalar())
    levelled = levelled.select("*", F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_level")).drop("_top")
    return levelled.withColumn("_block", F.call_function("shiftright", F.col(at).cast("long"), F.col("_level")))


def contained(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """All (point, interval) pairs with start <= at <= end within equal ``on``. Nulls and empty intervals match nothing.

    Pairs are counted by block before. More than ``HITS`` are dealt to so many more tasks, and blocks with many pairs are cut: their
    points go to pieces by chance, each with a copy of the block's intervals, or the other way round, whichever side is longer. So no task
    gets many more pairs than that, however many there are and however many a block has."""
    keys = [*on, "_level", "_block"]
    cut, levelled = _cut(intervals, start, end), _levelled(points, intervals, at, start, end)
    n = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_i")).join(levelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_p")), keys)
    n = saved(n.withColumn("_pairs", F.col("_i").cast("double") * F.col("_p")))
    pairs = n.agg(F.sum("_pairs")).collect()[0][0] or 0
    if pairs <= HITS:
        return levelled.join(cut, keys).drop("_level", "_block")
    # more pieces than rows on the longer side would be empty
    pieces = F.least(F.ceil(F.col("_pairs") * PIECES / HITS), F.greatest("_i", "_p")).cast("int")
    hot = n.select(*keys, pieces.alias("_parts"), (F.col("_p") >= F.col("_i")).alias("_points")).where(F.col("_parts") > 1)
    tasks = min(int(pairs // HITS) + 1, TASKS)

    def dealt(rows: DataFrame, by_chance: Column) -> DataFrame:
        every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        one = F.array(F.floor(F.rand(7) * F.coalesce("_parts", F.lit(1))).cast("int"))
        return rows.join(hot, keys, "left").withColumn("_part", F.explode(F.when(F.coalesce(by_chance, F.lit(True)), one).otherwise(every))).drop("_parts", "_points")

    near = [*keys, "_part"]
    sides = [dealt(rows, by_chance).repartition(tasks, *near) for rows, by_chance in ((levelled, F.col("_points")), (cut, ~F.col("_points")))]
    return sides[0].join(sides[1], near).drop("_level", "_block", "_part")


def best(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, order: list[Column]) -> DataFrame:
    """Each point with the first by ``order`` of the intervals that hold it; points in none are left out. All intervals of a block hold
    all of its points, so only the first of each block is kept, and positions are looked up once whatever the number of their points:
    the rows of each step are no more than intervals or points by their levels."""
    keys, rest = [*on, "_level", "_block"], [c for c in intervals.columns if c not in on]
    ranks = F.struct(*[F.struct(o.isNotNull(), o) for o in order])
    leaders = _cut(intervals.withColumn("_rank", ranks), start, end).groupBy(*keys).agg(F.min_by(F.struct("_rank", *rest), "_rank").alias("_best"))
    places = points.select(*on, at).distinct()
    won = _levelled(places, intervals, at, start, end).join(leaders, keys).groupBy(*on, at).agg(F.min_by("_best", "_best._rank").alias("_best"))
    return points.join(won, [*on, at]).select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in rest])
