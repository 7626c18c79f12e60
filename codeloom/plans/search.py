"""Search over symbols, files and lines, and the neighbourhood of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions import values as v
from ..functions.folding import casefold
from ..operators import lines as text
from ..operators import relational as rel
from . import trigrams

TYPES = ("symbol", "file", "text")


def checked_query(query: str) -> str:
    """The query, or ValueError: not empty, not ``*`` alone, not over 200 characters, no control characters."""
    value = (query or "").strip()
    if not value or value == "*" or len(value) > v.LIMITS["query_chars"] or any(ord(c) < 32 or ord(c) == 127 for c in value):
        raise ValueError("invalid query")
    return value


def _like(column: str, query: str):
    return F.col(column).ilike("%" + query.replace("\\", "\\\\") + "%")


def _first(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, limit: int = 20, offset: int = 0, candidates: int | None = None) -> DataFrame:
    """The best of all matches, or of the first ``candidates`` by id; every sort key descends."""
    q = checked_query(query)
    hits = _first(symbols.where(_like("name", q) | _like("qualified_name", q)), ["symbol_id"], candidates)
    hits = hits.join(files.select("file_id", "path"), "file_id").withColumn("rank", s.symbol_score(F.col("name"), F.col("qualified_name"), q)).withColumn("kind_rank", s.kind_rank(F.col("kind")))
    ordered = [F.desc("rank.score"), F.desc("rank.stanza"), F.desc("kind_rank"), casefold(F.col("name")).desc(), F.desc("path"), F.desc("symbol_id")]
    return rel.page(hits, ordered, limit, offset).select("symbol_id", "name", "qualified_name", "kind", "path", F.col("rank.score").alias("score"))


def search_files(files: DataFrame, symbols: DataFrame, query: str, limit: int = 20, offset: int = 0, candidates: int | None = None) -> DataFrame:
    """The best of all matches, or of the first ``candidates`` by id."""
    q = checked_query(query)
    hits = _first(files.where(_like("path", q)), ["file_id"], candidates).withColumn("score", s.file_score(F.col("path"), q))
    counts = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbol_count"))
    best = rel.page(hits, [F.desc("score"), F.desc("path"), F.desc("file_id")], limit, offset).select("file_id", "path", "score")
    return best.join(counts, "file_id", "left").fillna(0, ["symbol_count"]).orderBy(F.desc("score"), F.desc("path"), F.desc("file_id"))


def search_text(files: DataFrame, query: str, case_sensitive: bool = False, limit: int = 20, offset: int = 0, budget: int | None = None, most: int | None = None) -> DataFrame:
    """Lines that hold the query, by path and line; from files until ``budget`` bytes were read, at most ``most`` hits, if given."""
    q = checked_query(query)
    read = files.where("content IS NOT NULL")
    read = read if budget is None else rel.until_spent(read, "size_bytes", ["path"], budget)
    rows = text.lines(read.select("path", "content"))
    hit = F.col("line").contains(q) if case_sensitive else casefold(F.col("line")).contains(q.casefold())
    found = _first(rows.where(hit), ["path", "line_number"], most)
    return rel.page(found, ["path", "line_number"], limit, offset).select("path", "line_number", F.substring(F.trim("line"), 1, v.LIMITS["snippet"]).alias("snippet"))


def index_files(files: DataFrame, folder: str) -> None:
    """An index for ``search_text_by`` and, of paths, ``search_files_by``: ``files`` (file_id, path, content) in ``folder``."""
    trigrams.build(files, "file_id", ["content", "path"], folder)


def index_symbols(symbols: DataFrame, folder: str) -> None:
    """An index for ``search_symbols_by``: ``symbols`` (symbol_id, file_id, name, qualified_name, kind) in ``folder``."""
    trigrams.build(symbols, "symbol_id", ["name", "qualified_name"], folder)


def search_text_by(spark: SparkSession, folder: str, query: str, **options) -> DataFrame:
    """What ``search_text`` finds, by an index: only files that hold all trigrams of the query are read."""
    return search_text(trigrams.narrowed(spark, folder, "file_id", checked_query(query), wildcards=False), query, **options)


def search_symbols_by(spark: SparkSession, folder: str, files: DataFrame, query: str, **options) -> DataFrame:
    """What ``search_symbols`` finds, by an index."""
    return search_symbols(trigrams.narrowed(spark, folder, "symbol_id", checked_query(query)), files, query, **options)


def search_files_by(spark: SparkSession, folder: str, symbols: DataFrame, query: str, **options) -> DataFrame:
    """What ``search_files`` finds, by an index of the files."""
    return search_files(trigrams.narrowed(spark, folder, "file_id", checked_query(query)), symbols, query, **options)


def search(files: DataFrame, symbols: DataFrame, query: str, kind: str = "symbol", **options) -> DataFrame:
    """A page of one kind of search; ``total`` is the number of its rows."""
    if kind not in TYPES:
        raise ValueError(f"unknown search type {kind}")
    if kind == "symbol":
        found = search_symbols(symbols, files, query, **options)
    else:
        found = search_files(files, symbols, query, **options) if kind == "file" else search_text(files, query, **options)
    return found.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))  # a page


def definitions(chosen: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``chosen`` symbols with their path and the name of what holds them: what an investigation begins with."""
    parents = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), s.display_name(F.col("qualified_name"), F.col("name")).alias("parent"))
    return chosen.join(files.select("file_id", "path"), "file_id").join(parents, "parent_symbol_id", "left")


def investigate(edges: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: int, limit: int | None = None) -> DataFrame:
    """The edges of a symbol with both names, the evidence path and the group they belong to: all, or the first ``limit`` by type."""
    names = lambda end: symbols.select(F.col("symbol_id").alias(f"{end}_symbol_id"), s.display_name(F.col("qualified_name"), F.col("name")).alias(f"{end}_name"))
    touched = edges.where((F.col("source_symbol_id") == symbol_id) | (F.col("target_symbol_id") == symbol_id))
    rows = touched.join(files.select(F.col("file_id").alias("evidence_file_id"), F.col("path").alias("evidence_path")), "evidence_file_id", "left").join(names("source"), "source_symbol_id", "left").join(names("target"), "target_symbol_id", "left")
    group = F.when(F.col("status") == "EXTERNAL", "external").when(F.col("status") == "UNRESOLVED", "unresolved").when(F.col("type").isin("DEFINES", "EXTENDS", "IMPLEMENTS"), "dependencies")
    group = group.when(F.col("type") == "CALLS", F.when(F.col("source_symbol_id") == symbol_id, "callees").otherwise("callers")).otherwise(F.lower("type"))
    order = [c for c in ("relationship_id",) if c in rows.columns] or ["evidence_path", "start_line", "source_symbol_id", "target_symbol_id", "status"]
    return _first(rows.withColumn("group", group), ["type", *order], limit)


def related_files(investigated: DataFrame, files: DataFrame, limit: int = 100, own: str | None = None) -> DataFrame:
    """The symbol's own path, paths of evidence and of targets, sorted."""
    targets = investigated.select("target_file_id").join(files.select(F.col("file_id").alias("target_file_id"), "path"), "target_file_id").select("path")
    every = investigated.select(F.col("evidence_path").alias("path")).union(targets).where("path IS NOT NULL")
    if own is not None:
        every = every.union(files.sparkSession.range(1).select(F.lit(own).alias("path")))
    return every.distinct().orderBy("path").limit(limit)
