"""Bounded breadth-first traversal with the path of evidence to each node, joins a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import saved
from .relational import first_wins, numbered

SMALL = 10_000  # rows of a level that one task numbers and a join broadcasts; more are numbered by ranges
SENT = 100_000  # found nodes (a node, its parent and a number each) that a join broadcasts


def _ranked(rows: DataFrame, order: list[str], ahead: int) -> tuple[DataFrame, int]:
    """``rows``, saved, with ``rank``: dense numbers by ``order`` after ``ahead``; and how many they are."""
    rows = saved(rows)
    n = rows.count()
    if n > SMALL:
        return saved(numbered(rows, "_number", order).withColumn("rank", F.col("_number") + ahead).drop("_number")), n
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") + ahead), n


def ranked_bfs(roots: DataFrame, edges: DataFrame, max_depth: int, order: list[str] | None = None, carried: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``roots`` (node, rank), ``edges`` (source, target, kind, and the ``order`` columns) -> node, depth, rank, root, via,
    via_source, path: an array of structs (source, kind, target and the ``carried`` columns of edges) from the root outward; and
    whether nodes were left out.

    Nodes are ranked from 1 in the order in which a queue would find them: roots by their rank, then level by level by the rank of the
    first discoverer, the edge's ``order`` and the node. A node is taken at its least depth. At most ``limit`` nodes, roots counted, are
    kept; the rest of a level goes as it is found, and no level is expanded after that. Levels are saved one by one, and visited nodes leave
    by an anti-join. A level has far more edges than nodes: of all edges only the least parent of each node is kept, a number, by a hash
    aggregate. The edges between a node and that parent are then read again, and the path is added to the first of them, so no task sorts
    edges with their paths."""
    order, carried, types = order or ["kind"], carried or [], dict(edges.dtypes)
    node = dict(roots.dtypes)["node"]
    fields = {"source": node, "kind": types["kind"], "target": node} | {c: types[c] for c in carried}
    step = f"struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>"
    columns = ["node", "depth", "rank", "root", "via", "via_source", "path"]
    edges = saved(edges)
    start = first_wins(roots.select("node", F.col("rank").alias("_rank")), ["node"], ["_rank"])
    start, total = _ranked(start, ["_rank", "node"], 0)
    seen = start.select("node", F.lit(0).alias("depth"), "rank", F.col("node").alias("root"), F.lit(None).cast("string").alias("via"), F.lit(None).cast(node).alias("via_source"), F.expr(f"cast(array() AS array<{step}>)").alias("path"))
    truncated = limit is not None and total > limit
    seen = seen.where(F.col("rank") <= limit) if truncated else seen
    frontier, n = seen, total
    for depth in range(1, max_depth + 1):
        if truncated or not n:
            break
        lead = frontier.select(F.col("node").alias("source"), F.col("rank").alias("_parent"))
        near = (F.broadcast(lead) if n <= SMALL else lead).join(edges.select("source", "target"), "source")
        best = near.groupBy(F.col("target").alias("node")).agg(F.min("_parent").alias("_parent")).join(seen.select("node"), "node", "left_anti")
        best = saved(best.join(F.broadcast(lead) if n <= SMALL else lead, "_parent").withColumnRenamed("source", "_from"))
        first = F.broadcast(best) if best.count() <= SENT else best.hint("shuffle_hash")
        out = first.join(edges, (F.col("source") == F.col("_from")) & F.col("target").eqNullSafe(F.col("node")))
        out = out.select("node", "_parent", *[F.col(c).alias(f"_by_{c}") for c in order], F.struct(*fields).alias("_step"))
        by = ["_parent", *[f"_by_{c}" for c in order]]
        behind = frontier.select(F.col("rank").alias("_parent"), "root", "path")
        found = first_wins(out, ["node"], by).join(F.broadcast(behind) if n <= SMALL else behind, "_parent")
        found = found.select(
            "node", F.lit(depth).alias("depth"), *by, "root", F.col("_step.kind").cast("string").alias("via"),
            F.col("_step.source").alias("via_source"), F.concat("path", F.array("_step")).alias("path"),
        )
        found, n = _ranked(found, [*by, "node"], total)
        truncated = limit is not None and total + n > limit
        frontier = found.where(F.col("rank") <= limit).select(*columns) if truncated else found.select(*columns)
        seen, total = seen.unionByName(frontier), total + n
    return seen, truncated


def bounded_bfs(roots: DataFrame, edges: DataFrame, max_depth: int, order: list[str] | None = None, carried: list[str] | None = None) -> DataFrame:
    """All nodes that ``ranked_bfs`` finds without a limit."""
    return ranked_bfs(roots, edges, max_depth, order, carried)[0]
