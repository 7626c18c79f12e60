"""What a client shows of checklists and impact: filters, layered graphs, palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import relational as rel


def item_filters() -> dict[str, Column]:
    """Named filters over review items."""
    return {
        "all": F.lit(True), "required": F.col("priority") == "REQUIRED", "open": F.col("status") == "OPEN", "done": F.col("status") == "DONE",
        "tests": F.col("item_type") == "AFFECTED_TEST", "callers": F.col("item_type") == "AFFECTED_CALLER", "unresolved": F.col("item_type").isin("UNRESOLVED_IMPACT", "EXTERNAL_DEPENDENCY"),
    }


def filtered_items(items: DataFrame, name: str) -> DataFrame:
    """The items of a named filter by priority, then place."""
    rank = F.create_map(*[F.lit(x) for kv in v.PRIORITY_ORDER.items() for x in kv])
    return items.where(item_filters()[name]).orderBy(F.coalesce(F.try_element_at(rank, F.col("priority")), F.lit(9)), "sort", "stable_key")


def graph_nodes(nodes: DataFrame, max_depth: int | None = None, with_files: bool = True) -> DataFrame:
    """One node a name (the nearest, then the first id) with its layer, from 1, and its place in the layer by name."""
    shown = nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth)
    shown = shown if with_files else shown.where("node_type != 'FILE'")
    once = rel.first_wins(shown.select("name", "node", "node_type", "depth"), ["name"], ["depth", "node"]).withColumn("layer", F.greatest("depth", F.lit(1)))
    return once.withColumn("column", F.row_number().over(Window.partitionBy("layer").orderBy("name")) - 1)


def graph_edges(paths: DataFrame, shown: DataFrame) -> DataFrame:
    """The distinct steps of paths (source, kind, target) between nodes that are shown."""
    steps = paths.select(F.explode("path").alias("s")).select("s.source", "s.kind", "s.target").distinct()
    names = shown.select("node")
    return steps.join(names.withColumnRenamed("node", "source"), "source", "left_semi").join(names.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "kind", "target")


def paths_through(paths: DataFrame, node: str) -> DataFrame:
    """Paths that begin, end or pass at a node."""
    return paths.where((F.col("root") == node) | (F.col("target") == node) | F.exists("path", lambda p: (p["source"] == node) | (p["target"] == node)))


def palette(entries: DataFrame, typed: str, column: str = "label") -> DataFrame:
    """Entries that hold what was typed, in any case; all for nothing."""
    return entries.where(F.contains(F.lower(column), F.lit(typed.strip().lower())))


def symbols_of_file(mapped: DataFrame, file_id: int) -> DataFrame:
    return mapped.where(F.col("file_id") == file_id).orderBy("name", "symbol_id")


def by_share(shares: DataFrame) -> DataFrame:
    return shares.orderBy(F.desc("share"), "language")
