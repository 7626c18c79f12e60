"""Generic relational operators: what wins, what is unique, what lies inside, what fits a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import best
from .intervals import contained as intervals_by_bin
from .lineage import saved

Keys = list[str]


def first_wins(df: DataFrame, keys: Keys, order: list[Column | str]) -> DataFrame:
    """The first row of each key (nulls are one key), by a total order. Rows that cannot win are dropped before the
    exchange: ``min_by`` over a struct aggregates partially, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    ranks = F.struct(*[F.struct(F.expr(o).isNotNull() if isinstance(o, str) else o.isNotNull(), F.expr(o) if isinstance(o, str) else o) for o in order])
    won = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranks).alias("_row"))
    return won.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: Keys, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    won = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_row"))
    return won.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def lookup_by_priority(df: DataFrame, candidates: Column, table: DataFrame, key: str, value: str, id_: Keys, scope: Keys | None = None) -> DataFrame:
    """Left lookup of the first of several candidate keys that ``table`` (key, value) has: ``value`` and ``matched_priority``.
    ``scope``: columns that have to be equal besides."""
    scope = scope or []
    tried = df.select(*id_, *scope, F.posexplode(candidates).alias("matched_priority", key)).join(table.select(*scope, key, value), [*scope, key])
    best = tried.groupBy(*id_).agg(F.min(F.struct("matched_priority", value)).alias("_b")).select(*id_, f"_b.{value}", "_b.matched_priority")
    return df.join(best, id_, "left")


def singles(table: DataFrame, keys: Keys, values: list[str]) -> DataFrame:
    """keys and values of the rows that are alone in their key."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in values]).where("_n = 1").drop("_n")


def unique_match(df: DataFrame, table: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Left lookup that binds only where exactly one row of ``table`` has the key."""
    return df.join(singles(table, keys, [value]), keys, "left")


def contained(points: DataFrame, intervals: DataFrame, on: Keys, at: str, start: str, end: str) -> DataFrame:
    """All (point, interval) pairs with start <= at <= end within equal ``on``, by an index of intervals."""
    return intervals_by_bin(points, intervals, on, at, start, end)


def innermost(points: DataFrame, intervals: DataFrame, on: Keys, at: str, start: str, end: str, point_id: Keys, interval_id: str) -> DataFrame:
    """The innermost interval of each point: latest start, then earliest end, then least id."""
    order = [F.negative(start), F.col(end), F.col(interval_id)]
    return first_wins(best(points, intervals, on, at, start, end, order), point_id, [F.negative(start), end, interval_id])


def capped_per_key(df: DataFrame, keys: Keys, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of each key (keys are not null), the first by ``order``. Keys are counted first, and only the rows of those
    over the limit are sorted: by ranges of (keys, order), whose sizes tell where a range begins within its key, so that a key of any
    size is cut by many tasks and ranges beyond the limit are not sorted at all."""
    df = saved(df)
    over = saved(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys))
    if not over.limit(1).count():
        return df
    dealt = saved(df.join(over, keys, "left_semi").repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # a key has a row a range at most: what lies ahead of each, as running sums of an array
    by_key = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_r"))
    ahead = by_key.select(*keys, "_r", F.posexplode("_r").alias("_at", "_one"))
    ahead = ahead.select(*keys, "_one._range", F.aggregate(F.slice("_r", F.lit(1), F.col("_at")), F.lit(0).cast("long"), lambda n, r: n + r["_n"]).alias("_ahead"))
    near = dealt.join(ahead.where(F.col("_ahead") < limit), [*keys, "_range"])
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) + F.col("_ahead")
    cut = near.withColumn("_place", place).where(F.col("_place") <= limit)
    return df.join(over, keys, "left_anti").unionByName(cut.select(*df.columns))


def first_listed(df: DataFrame, keys: Keys, order: list[str], entry: Column, k: int, name: str = "entries") -> DataFrame:
    """keys and ``name``: an array of ``entry`` of each key's first ``k`` rows by ``order``. Spark keeps ``k`` rows of a key in each task
    before the exchange (its limit of groups covers 1000), so no task or array holds a group of more than that a task."""
    few = df.select(*keys, *order, entry.alias("_e")).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k)
    listed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", "_e"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["_e"]).alias(name))


def numbered(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``df`` with dense numbers from 1 by ``order``: ranges are numbered apart, after a prefix sum of their sizes, so no task holds
    all rows."""
    dealt = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(ahead), "_range").withColumn(name, (F.col("_ahead") + inside).cast("long")).drop("_range", "_ahead")


def capped(df: DataFrame, order: list[Column | str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows by ``order``, and one row (truncated, reason candidate) telling whether more were there."""
    more = df.orderBy(*order).limit(limit + 1)
    return df.orderBy(*order).limit(limit), more.agg((F.count(F.lit(1)) > limit).alias("truncated"))


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def within_budget(df: DataFrame, cost: str, order: list[Column | str], budget: int, partition: Keys | None = None) -> DataFrame:
    """The leading rows whose running cost stays within ``budget``; a row that does not fit ends its partition."""
    ahead = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_cost", F.sum(cost).over(ahead)).where(F.col("running_cost") <= budget)


def until_spent(df: DataFrame, cost: str, order: list[Column | str], budget: int, partition: Keys | None = None) -> DataFrame:
    """The leading rows before which less than ``budget`` was spent: the row that crosses it is still taken. Without a partition,
    ranges of the order are summed up first, and each range by itself then."""
    if not partition:
        dealt = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
        sums = dealt.groupBy("_range").agg(F.sum(cost).alias("_sum"))
        before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
        inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        spent = F.col("_before") + F.coalesce(F.sum(cost).over(inside), F.lit(0))
        return dealt.join(F.broadcast(before.where(F.col("_before") < budget)), "_range").withColumn("spent", spent).where(F.col("spent") < budget).drop("_range", "_before")
    ahead = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("spent", F.coalesce(F.sum(cost).over(ahead), F.lit(0))).where(F.col("spent") < budget)


def top_k(df: DataFrame, keys: Keys, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def carried_over(new: DataFrame, previous: DataFrame, key: str, columns: dict[str, object]) -> DataFrame:
    """State of a previous version by key; defaults for what is new."""
    old = previous.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    out = new.join(old, key, "left")
    return out.withColumns({c: F.coalesce(f"_old_{c}", F.lit(d)) for c, d in columns.items()}).drop(*[f"_old_{c}" for c in columns])


def histogram(df: DataFrame, keys: Keys, by: str) -> DataFrame:
    """keys, n, and counts by value as a map with sorted keys."""
    each = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*keys).agg(F.sum("_n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(by), F.col("_n"))))).alias("histogram"))


def absent(df: DataFrame, table: DataFrame, on: Keys) -> DataFrame:
    return df.join(table, on, "left_anti")


def either_end(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    """Edges that touch a node, by two equi-joins instead of a disjunction; each pair once."""
    out = edges.join(nodes.select(F.col(node).alias(source), F.col(node).alias("touched")), source)
    back = edges.where(F.col(source).isNull() | (F.col(source) != F.col(target))).join(nodes.select(F.col(node).alias(target), F.col(node).alias("touched")), target)
    return out.unionByName(back)
