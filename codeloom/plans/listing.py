"""Filtered pages over the tables of repositories, each row with the total of all rows that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import relational as rel
from .search import _like, checked_query


def where_given(df: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """The rows that fulfil all conditions that are given."""
    for condition in conditions.values():
        if condition is not None:
            df = df.where(condition)
    return df


def equals(column: str, value: str | None) -> Column | None:
    """Equal in any case, if a value is given."""
    return None if value is None else F.lower(column) == value.lower()


def like(column: str, value: str | None) -> Column | None:
    return None if value is None else _like(column, checked_query(value))


def paged(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page, and in each row the ``total`` of rows before the page was cut."""
    return rel.page(df, order, limit, offset).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row


def of_repository(table: DataFrame, files: DataFrame, repository_id: int) -> DataFrame:
    """Rows of a repository's files, with the path."""
    return table.join(files.where(F.col("repository_id") == repository_id).select("file_id", "path", "language"), "file_id")


def symbols(table: DataFrame, files: DataFrame, repository_id: int, file: str | None = None, name: str | None = None, kind: str | None = None, language: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """Symbols by path and line."""
    rows = of_repository(table, files, repository_id)
    rows = where_given(rows, {"file": None if file is None else F.col("path") == file, "name": like("name", name), "kind": equals("kind", kind), "language": equals("language", language)})
    return paged(rows, ["path", "line_start", "symbol_id"], min(limit, 2000), offset)


def imports(table: DataFrame, files: DataFrame, repository_id: int, source: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    return paged(where_given(of_repository(table, files, repository_id), {"source": like("source", source)}), ["path", "start_line", "import_id"], min(limit, 2000), offset)


def exports(table: DataFrame, files: DataFrame, repository_id: int, limit: int = 200, offset: int = 0) -> DataFrame:
    return paged(of_repository(table, files, repository_id), ["path", "start_line", "export_id"], min(limit, 2000), offset)


def relationships(edges: DataFrame, symbols_: DataFrame, files: DataFrame, repository_id: int, type: str | None = None, status: str | None = None, file: str | None = None, source: str | None = None, target: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """Edges by type and evidence. ``source`` and ``target`` are names of symbols; the edges of any symbol of the name fit."""
    rows = edges.join(files.where(F.col("repository_id") == repository_id).select(F.col("file_id").alias("evidence_file_id"), F.col("path").alias("evidence_path")), "evidence_file_id")
    rows = where_given(rows, {"type": equals("type", type), "status": equals("status", status), "file": None if file is None else F.col("evidence_path") == file})
    for end, name in (("source", source), ("target", target)):
        if name is not None:
            rows = rows.join(symbols_.where(F.col("name") == name).select(F.col("symbol_id").alias(f"{end}_symbol_id")), f"{end}_symbol_id", "left_semi")
    names = lambda end: symbols_.select(F.col("symbol_id").alias(f"{end}_symbol_id"), F.col("name").alias(f"{end}_name"))
    named = rows.join(names("source"), "source_symbol_id", "left").join(names("target"), "target_symbol_id", "left")
    return paged(named, ["type", "evidence_path", "start_line", "source_symbol_id", "target_symbol_id", "status"], min(limit, 2000), offset)


def neighbours(edges: DataFrame, symbol_id: int, limit: int = 200, offset: int = 0) -> DataFrame:
    """The edges of a symbol, outgoing before incoming."""
    incoming = F.coalesce(F.col("source_symbol_id") != symbol_id, F.lit(True))
    touched = edges.where((F.col("source_symbol_id") == symbol_id) | (F.col("target_symbol_id") == symbol_id)).withColumn("incoming", incoming)
    return paged(touched, ["incoming", "type", "evidence_file_id", "start_line", "source_symbol_id", "target_symbol_id", "status"], limit, offset)


def file_counts(files: DataFrame, symbols_: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, path, symbol_count, relationship_count of each file."""
    own = symbols_.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbol_count"))
    touching = edges.groupBy(F.col("evidence_file_id").alias("file_id")).agg(F.count(F.lit(1)).alias("relationship_count"))
    return files.select("file_id", "path").join(own, "file_id", "left").join(touching, "file_id", "left").fillna(0, ["symbol_count", "relationship_count"])


def content(files: DataFrame, repository_id: int, path: str, start: int = 1, end: int = 1 << 30) -> DataFrame:
    """Lines of one file. A path that leaves its root is refused; so is a file that was too large to read."""
    rows = files.where((F.col("repository_id") == repository_id) & (F.col("path") == path) & s.is_contained(F.lit(path)))
    text = F.when(F.col("content").isNull(), F.raise_error(F.lit("file too large"))).otherwise(s.snippet(F.col("content"), F.lit(start), F.lit(end)))
    return rows.select("path", text.cast("string").alias("content"))


def latest(table: DataFrame, key: str, limit: int) -> DataFrame:
    return table.orderBy(F.desc(key)).limit(limit)


def recent(tables: dict[str, tuple[DataFrame, str]], each: int = 3) -> DataFrame:
    """The latest rows of several tables (name -> table and its id): kind, id."""
    parts = [latest(t, key, each).select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("id")) for name, (t, key) in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
