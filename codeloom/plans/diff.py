"""Differences between revisions: snapshots or unified diffs, mapped to symbols."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions import values as v
from ..operators import lines as text
from ..operators import relational as rel


def snapshot_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, status, old_path of changed files between two (path, content) snapshots: a deleted and an added file of equal
    content are a rename (the first of several, by path)."""
    a = base.select("path", F.sha2("content", 256).alias("old"))
    b = head.select("path", F.sha2("content", 256).alias("new"))
    both = a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    added = both.where("old IS NULL").select(F.col("new").alias("h"), "path")
    gone = both.where("new IS NULL").select(F.col("old").alias("h"), F.col("path").alias("old_path"))
    renamed = added.groupBy("h").agg(F.min("path").alias("path")).join(gone.groupBy("h").agg(F.min("old_path").alias("old_path")), "h").select("path", "old_path")
    rest = both.join(renamed.select("path"), "path", "left_anti").join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti")
    status = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "DELETED").otherwise("MODIFIED")
    return rest.select("path", status.alias("status"), F.lit(None).cast("string").alias("old_path")).union(renamed.select("path", F.lit("RENAMED"), "old_path")).withColumn("file_category", s.file_category(F.col("path")))


def numstat(name_status: DataFrame, counts: DataFrame) -> DataFrame:
    """(code, path, old_path) with (additions, deletions, path); ``-`` marks binary files."""
    known = counts.select(s.numstat_path(F.col("path")).alias("path"), "additions", "deletions")
    rows = name_status.join(known, "path", "left")
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS INT)"), F.lit(0))
    return rows.select("path", "old_path", s.diff_status(F.col("code")).alias("status"), number("additions").alias("additions"), number("deletions").alias("deletions"), F.coalesce(F.col("additions") == "-", F.lit(False)).alias("binary"), s.file_category(F.col("path")).alias("file_category"))


def linked(changes: DataFrame, files: DataFrame) -> DataFrame:
    """old_file_id and new_file_id by path (old_path of renames and copies)."""
    ids = files.select("path", "file_id")
    out = changes.join(ids.toDF("path", "new_file_id"), "path", "left")
    return out.withColumn("_old", F.coalesce("old_path", "path")).join(ids.toDF("_old", "old_file_id"), "_old", "left").drop("_old")


def mapped_symbols(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """``changed`` (file_id, side, line_number) -> added and deleted lines of every symbol that holds them, and the change
    type, which follows from the whole file's counts."""
    # equal lines of a file are one point, so a hot line costs a row a task
    points = changed.groupBy("file_id", "line_number").agg(F.count_if(F.col("side") == "NEW").alias("_new"), F.count_if(F.col("side") == "OLD").alias("_old"))
    inside = rel.contained(points, symbols.select("symbol_id", "file_id", "name", "kind", "line_start", "line_end"), ["file_id"], "line_number", "line_start", "line_end")
    per = inside.groupBy("symbol_id", "file_id", "name", "kind").agg(F.sum("_new").alias("added_lines"), F.sum("_old").alias("deleted_lines"))
    whole = points.groupBy("file_id").agg(F.sum("_new").alias("_a"), F.sum("_old").alias("_d"))
    return per.join(whole, "file_id").withColumn("change_type", s.change_type(F.col("_a"), F.col("_d"))).drop("_a", "_d")


def analysed(diffs: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``diffs`` (file_id, diff) -> numbered changed lines, and mapped symbols."""
    changed = text.changed_lines(text.hunks(diffs, ["file_id"]))
    return changed, mapped_symbols(changed, symbols)


def totals(changes: DataFrame, mapped: DataFrame) -> DataFrame:
    sums = changes.agg(F.count(F.lit(1)).alias("files_changed"), F.sum("additions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return sums.crossJoin(mapped.agg(F.count(F.lit(1)).alias("symbols_changed")))  # one row each


def detail(mapped: DataFrame) -> DataFrame:
    """Changed symbols of each file and how many of each change type."""
    return rel.histogram(mapped, ["file_id"], "change_type")


class DiffTooLarge(ValueError):
    """A diff is larger than allowed."""


def checked(changes: DataFrame, numbered: DataFrame, most_files: int = v.DIFF_LIMITS["files"], most_hunks: int = v.DIFF_LIMITS["hunks"], most_lines: int = v.DIFF_LIMITS["lines"], diffs: DataFrame | None = None, most_bytes: int = v.DIFF_LIMITS["bytes"]) -> DataFrame:
    """``changes``, or DiffTooLarge. ``numbered``: the lines of its hunks; ``diffs``: their texts."""
    n = changes.count(), numbered.select("file_id", "hunk").distinct().count(), numbered.where("side IS NOT NULL").count(), 0
    if diffs is not None:
        n = (*n[:3], diffs.agg(F.sum(F.octet_length("diff"))).collect()[0][0] or 0)
    if n[0] > most_files or n[1] > most_hunks or n[2] > most_lines or n[3] > most_bytes:
        raise DiffTooLarge(f"{n[0]} files, {n[1]} hunks, {n[2]} lines, {n[3]} bytes")
    return changes


def stored_hunks(numbered: DataFrame) -> DataFrame:
    """file_id, hunk, header, starts and counts, and the content of each hunk of numbered lines."""
    mark = F.when(F.col("side") == "NEW", "+").when(F.col("side") == "OLD", "-").otherwise(" ")
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(mark, "text").alias("t"))))
    keys = ["file_id", "hunk", "header", "old_start", "old_count", "new_start", "new_count"]
    return numbered.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("content"))


class SameRevision(ValueError):
    """Base and head of a diff are the same revision."""


def identity(repository_id: int, base: str, head: str) -> int:
    """The number of a diff between two resolved revisions, the same whoever asks; SameRevision for equal ones."""
    base, head = base.strip(), head.strip()
    if not base or not head:
        raise ValueError("a diff has a base and a head")
    if base == head:
        raise SameRevision("base and head revisions must be different")
    return int.from_bytes(sha256(f"{repository_id}:{base}:{head}".encode()).digest()[:7], "big")


def snapshot_revision(files: DataFrame) -> str:
    """A name for a snapshot (path, content) that has no commit: equal for equal files, in any order."""
    each = F.xxhash64("path", "content", F.col("content").isNull()).cast("decimal(38,0)")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each), F.lit(0)).alias("s"), F.coalesce(F.sum(F.xxhash64(F.lit(7), "path", "content").cast("decimal(38,0)")), F.lit(0)).alias("t")).collect()[0]
    return sha256(f"{row['n']}:{row['s']}:{row['t']}".encode()).hexdigest()


def in_order(files: DataFrame | None = None, hunks: DataFrame | None = None, lines: DataFrame | None = None, symbols: DataFrame | None = None) -> list[DataFrame]:
    """What is given, as it is read: files by path, hunks by start, lines by side and number, symbols by file and name."""
    keys = [(files, ["path"]), (hunks, ["old_start", "new_start"]), (lines, ["side", "line_number"]), (symbols, ["file_id", "name", "symbol_id"])]
    return [df.orderBy(*order) for df, order in keys if df is not None]
