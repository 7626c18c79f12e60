"""Renames and copies by what files have in common, line by line.

A line weighs 1,000,000 over the number of files that hold it. The similarity of two files is twice the weight that they share (as often
as both hold a line) over the weight of both, in thousandths. Pairs are found through an inverted index of line digests, but not of all
lines: a file of similarity ``least`` shares more than its commonest lines can weigh together, so only the others, its rarest, are
looked up (a prefix filter, which loses no pair). So a line that every file holds joins nothing.

Only digests of lines are dealt, never texts or lines: a file is a row of its lines' weights, and two files are compared where their rows
meet.

Cases: null contents have no lines; empty files are similar to none; equal paths on both sides are as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import saved
from ..operators.relational import first_wins

LEAST = 500
UNIT = 1_000_000


def _digests() -> Column:
    """The digests of a file's lines."""
    return F.when(F.col("content") != "", F.transform(F.split("content", "\n"), lambda x: F.xxhash64(x))).otherwise(F.expr("cast(array() AS array<long>)"))


def _weighed(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, path, total, bag: the lines (weight, line, n) of each file, commonest first; of files (path, lines)."""
    counted = [f.repartition("path").select("path", F.explode("lines").alias("line")).groupBy("path", "line").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(k)) for k, f in enumerate((left, right))]
    both = saved(counted[0].unionByName(counted[1]))
    weights = both.groupBy("line").agg(F.count(F.lit(1)).alias("_files")).select("line", F.floor(F.lit(UNIT) / F.col("_files")).cast("long").alias("weight"))
    bag = F.array_sort(F.collect_list(F.struct("weight", "line", "n"))).alias("bag")
    return saved(both.join(weights, "line").groupBy("side", "path").agg(F.sum(F.col("n") * F.col("weight")).alias("total"), bag))


def _rarest(weighed: DataFrame, least: int) -> DataFrame:
    """The lines of each file, rarest first, until the rest can't make up the least overlap, least / (2000 - least) of the whole."""
    none = F.struct(F.lit(0).cast("long").alias("rest"), F.lit(0).alias("skipped"))

    def step(at: Column, x: Column) -> Column:
        rest = at["rest"] + x["n"] * x["weight"]  # of this line and commoner ones
        return F.struct(rest.alias("rest"), (at["skipped"] + (rest * (2000 - least) < F.col("total") * least).cast("int")).alias("skipped"))

    kept = F.slice("bag", F.aggregate("bag", none, step)["skipped"] + 1, F.size("bag"))
    return weighed.select("path", F.explode(kept).alias("_x")).select("path", "_x.line")


def _overlap(a: str, b: str) -> Column:
    """The weight that two bags share: the lines of both in one order, where a line of both stands twice."""
    ordered = F.array_sort(F.transform(F.concat(a, b), lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), x["weight"].alias("weight"))))
    none = F.struct(F.lit(None).cast("long").alias("line"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"))

    def step(at: Column, x: Column) -> Column:
        both = F.when(at["line"] == x["line"], F.least(at["n"], x["n"]) * x["weight"]).otherwise(F.lit(0).cast("long"))
        return F.struct(x["line"].alias("line"), x["n"].alias("n"), (at["sum"] + both).alias("sum"))

    return F.aggregate(ordered, none, step)["sum"]


def _similar(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """``similar`` of files (path, lines)."""
    weighed = _weighed(left, right)
    a, b = [weighed.where(F.col("side") == k).select(F.col("path").alias(f"{name}_path"), F.col("bag").alias(f"_{name}"), F.col("total").alias(f"_t{name}")) for k, name in enumerate(("left", "right"))]
    prefix = [_rarest(weighed.where(F.col("side") == k), least).withColumnRenamed("path", f"{name}_path") for k, name in enumerate(("left", "right"))]
    pairs = prefix[0].join(prefix[1], "line").select("left_path", "right_path").distinct()
    shared = pairs.join(a, "left_path").join(b, "right_path").withColumn("_o", _overlap("_left", "_right"))
    return shared.select("left_path", "right_path", F.expr("(2000 * _o) div (_tleft + _tright)").alias("score")).where(F.col("score") >= least)


def similar(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """``left`` and ``right`` (path, content) -> left_path, right_path, score (thousandths, from ``least``)."""
    return _similar(*[side.select("path", _digests().alias("lines")) for side in (left, right)], least)


def similar_classes(left: DataFrame, right: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``similar`` between files of different content only, each by the first path of its content, and the two memberships (path,
    representative): many equal files make one pair."""
    first, members = [], []
    for side in (left, right):
        named = side.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("_h"), _digests().alias("lines"))
        each = saved(named.groupBy("_h").agg(F.min("path").alias("representative"), F.first("lines").alias("lines")))
        first.append(each.select(F.col("representative").alias("path"), "lines"))
        members.append(named.select("path", "_h").join(each.select("_h", "representative"), "_h").select("path", "representative"))
    return _similar(*first, least), *members


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs that are taken if one goes through all by score, left and right path and takes each whose ends are free. In a round all
    pairs go that are the best of both their ends; the first of all is among them."""
    left = saved(pairs)
    taken = left.limit(0)
    while left.limit(1).count():
        order = F.struct(F.negative("score").alias("o"), F.col("left_path").alias("l"), F.col("right_path").alias("r"))
        best = lambda end: left.groupBy(end).agg(F.min(order).alias("_o")).select(F.col("_o.l").alias("left_path"), F.col("_o.r").alias("right_path"))  # noqa: E731, B023
        mutual = best("left_path").join(best("right_path"), ["left_path", "right_path"])
        won = saved(left.join(mutual, ["left_path", "right_path"]))
        taken = taken.unionByName(won)
        left = saved(left.join(won.select("left_path"), "left_path", "left_anti").join(won.select("right_path"), "right_path", "left_anti"))
    return taken


def renames(changes: DataFrame, base: DataFrame, head: DataFrame, least: int = LEAST) -> DataFrame:
    """``changes`` (see ``diff.snapshot_diff``) where deleted and added files that are similar are one rename each, and other added
    files that are similar to one of ``base`` a copy of the most similar (ties: the first by path); with the score, 1000 of equal ones."""
    gone = base.join(changes.where("status = 'DELETED'").select("path"), "path", "left_semi")
    new = head.join(changes.where("status = 'ADDED'").select("path"), "path", "left_semi")
    moved = saved(one_to_one(similar(gone, new, least)))
    rest = new.join(moved.select(F.col("right_path").alias("path")), "path", "left_anti")
    copied = first_wins(similar(base.join(moved.select(F.col("left_path").alias("path")), "path", "left_anti"), rest, least), ["right_path"], [F.negative("score"), "left_path"])
    found = moved.withColumn("_status", F.lit("RENAMED")).unionByName(copied.withColumn("_status", F.lit("COPIED")))
    kept = changes.join(moved.select(F.col("left_path").alias("path")), "path", "left_anti")
    out = kept.join(found.withColumnRenamed("right_path", "path"), "path", "left")
    score = F.coalesce("score", F.when(F.col("status") == "RENAMED", F.lit(1000)))
    return out.withColumns({"status": F.coalesce("_status", "status"), "old_path": F.coalesce("left_path", "old_path"), "score": score}).drop("_status", "left_path")
