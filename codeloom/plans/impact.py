"""Bounded impact traversal from changed symbols and files.

Nodes are strings: ``S<symbol_id>`` or ``F<file_id>``. A symbol is reached again through the class or interface that
holds it; a file passes impact on only if it is a root without changed symbols. An edge whose source is a file, or
that TESTS, leads to the file of its evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions import values as v
from ..operators.lineage import saved
from ..operators.relational import first_listed, first_wins
from ..operators.traversal import ranked_bfs


MOST_NUMBERED = 10_000  # open ends that one task numbers; a greater limit is no limit

# fixed values: why a result was cut, the first that holds
NODE_LIMIT, UNRESOLVED_LIMIT, EXTERNAL_LIMIT, PATH_LIMIT = "impact node limit reached", "unresolved node limit reached", "external node limit reached", "impact path limit reached"


def roots(mapped: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """node, rank, file_level: changed symbols by path, name and id, then changed files by path."""
    paths = files.select("file_id", "path")
    symbols = mapped.join(paths, "file_id").select(F.concat(F.lit("S"), "symbol_id").alias("node"), F.struct(F.lit(0).alias("a"), F.col("path").alias("b"), F.col("name").alias("c"), F.col("symbol_id").cast("long").alias("d")).alias("rank"), F.lit(False).alias("file_level"))
    own = changes.select(F.coalesce("new_file_id", "old_file_id").alias("file_id"), "path").where("file_id IS NOT NULL").join(mapped.select("file_id", F.lit(True).alias("has")).distinct(), "file_id", "left")
    return symbols.union(own.select(F.concat(F.lit("F"), "file_id"), F.struct(F.lit(1).alias("a"), F.col("path").alias("b"), F.lit("").alias("c"), F.lit(0).cast("long").alias("d")), F.col("has").isNull()))


def adjacency(edges: DataFrame, symbols: DataFrame, files: DataFrame, root_nodes: DataFrame) -> DataFrame:
    """Reversed edges (source: what changed, target: what it affects) with their order; changed files lead on only at file level."""
    used = edges.where(F.col("type").isin(list(v.EDGE_PRIORITY)) & (F.col("status") == "RESOLVED"))
    used = used.join(files.select(F.col("file_id").alias("evidence_file_id"), F.col("path").alias("_path")), "evidence_file_id", "left")
    lead = F.when(F.col("source_symbol_id").isNull() | (F.col("type") == "TESTS"), F.concat(F.lit("F"), "evidence_file_id")).otherwise(F.concat(F.lit("S"), "source_symbol_id"))
    order = [s.edge_priority(F.col("type")).alias("priority"), F.coalesce("evidence_file_id", F.lit(0)).alias("at_file"), F.col("start_line").alias("at_line"), F.concat_ws(":", "_path", F.col("start_line").cast("string")).alias("at")]
    by_symbol = used.where("target_symbol_id IS NOT NULL").select(F.concat(F.lit("S"), "target_symbol_id").alias("source"), lead.alias("target"), F.col("type").alias("kind"), *order, F.lit(0).alias("through"))
    by_file = used.where("target_symbol_id IS NULL AND target_file_id IS NOT NULL").select(F.concat(F.lit("F"), "target_file_id").alias("source"), lead.alias("target"), F.col("type").alias("kind"), *order, F.lit(0).alias("through"))
    file_level = root_nodes.where("file_level").select(F.col("node").alias("source"))
    # what uses a class is affected by its members
    holders = symbols.where(F.col("kind").isin(v.CONTAINER_KINDS)).select(F.col("symbol_id").alias("parent_symbol_id"))
    held = symbols.where("parent_symbol_id IS NOT NULL").join(holders, "parent_symbol_id").select(F.concat(F.lit("S"), "symbol_id").alias("member"), F.concat(F.lit("S"), "parent_symbol_id").alias("source"))
    through = by_symbol.join(held, "source").select(F.col("member").alias("source"), "target", "kind", "priority", "at_file", "at_line", "at", F.lit(1).alias("through"))
    return by_symbol.union(through).union(by_file.join(file_level, "source", "left_semi")).where("source != target")


def traversed(root_nodes: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame, max_depth: int = 2, limit: int = v.LIMITS["impact_nodes"]) -> DataFrame:
    """node, depth, rank, via, via_source, path (steps with file:line), node_type, name, file_path, is_test, impact_class, truncated and
    why; roots have depth 0. At most ``limit`` nodes, roots counted, in the order in which they are found."""
    order = ["through", "priority", "at_file", "at_line", "kind"]
    root_nodes = saved(root_nodes)  # read for the first level and for the files that lead on
    reach, cut = ranked_bfs(root_nodes.select("node", "rank"), adjacency(edges, symbols, files, root_nodes), min(max_depth, v.LIMITS["depth"]), order, ["at"], limit)
    named = symbols.select(F.concat(F.lit("S"), "symbol_id").alias("node"), s.display_name(F.col("qualified_name"), F.col("name")).alias("name"), "kind", "file_id").join(files.select("file_id", F.col("path").alias("file_path")), "file_id").drop("file_id")
    named = named.union(files.select(F.concat(F.lit("F"), "file_id"), "path", F.lit(None).cast("string"), "path").toDF("node", "name", "kind", "file_path"))
    out = reach.join(named, "node", "left").withColumn("node_type", F.when(F.col("node").startswith("S"), "SYMBOL").otherwise("FILE"))
    out = out.withColumn("is_test", (F.col("node_type") == "FILE") & ((F.col("via") == "TESTS") | (s.file_category(F.col("file_path")) == "TEST"))).withColumn("impact_class", F.when(F.col("depth") == 0, "DIRECT").otherwise("POTENTIAL"))
    return out.withColumns({"truncated": F.lit(cut), "truncated_reason": F.lit(NODE_LIMIT if cut else None).cast("string")})


def open_ends(root_nodes: DataFrame, edges: DataFrame, status: str, limit: int = v.LIMITS["unresolved"]) -> DataFrame:
    """UNRESOLVED or EXTERNAL edges of the roots; of a file's external imports one stays, of equal unresolved ones the first.
    ``more``: whether there were over ``limit``."""
    ids = root_nodes.select(F.col("node").alias("owner"))
    owner = F.coalesce(F.concat(F.lit("S"), "source_symbol_id"), F.concat(F.lit("F"), "evidence_file_id"))
    own = edges.where(F.col("status") == status).withColumn("owner", owner).join(ids, "owner", "left_semi")
    keys = ["target_file_id", "evidence_file_id"] if status == "EXTERNAL" else ["owner", "evidence_file_id", "type", "start_line"]
    order = ["evidence_file_id", "start_line", "evidence"]
    some = first_wins(own, keys, ["start_line", "evidence"]).orderBy(*order).limit(min(limit, (1 << 31) - 2) + 1)
    place = Window.partitionBy().orderBy(*order)
    if limit > MOST_NUMBERED:
        return some.withColumn("more", F.lit(False))
    some = some.withColumns({"_place": F.row_number().over(place), "more": F.count(F.lit(1)).over(Window.partitionBy()) > limit})  # ``limit`` rows and one
    return some.where(F.col("_place") <= limit).drop("_place")


def summary(nodes: DataFrame, unresolved: DataFrame, external: DataFrame, most_paths: int = v.LIMITS["impact_paths"]) -> DataFrame:
    """One row of counters. The first limit that was reached tells why a result was cut: of nodes, of open ends, of paths."""
    direct, potential = F.col("impact_class") == "DIRECT", F.col("impact_class") == "POTENTIAL"
    main = nodes.agg(
        F.count_if(direct & (F.col("node_type") == "SYMBOL")).alias("changed_symbols"), F.count_if(direct & (F.col("node_type") == "FILE")).alias("changed_files"), F.count_if(direct).alias("total_direct"),
        F.count_if(potential & ~F.col("is_test")).alias("potential"), F.count_if(potential & F.col("is_test")).alias("affected_tests"), F.max("depth").alias("deepest"), F.max("truncated_reason").alias("_cut"), F.count_if(potential).alias("_reached"),
    )
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.coalesce(F.max("more"), F.lit(False)).alias(f"_more_{name}"))
    row = main.crossJoin(count(unresolved, "unresolved")).crossJoin(count(external, "external"))  # one row each
    why = F.coalesce("_cut", F.when(F.col("_more_unresolved"), UNRESOLVED_LIMIT), F.when(F.col("_more_external"), EXTERNAL_LIMIT), F.when(F.col("_reached") > most_paths, PATH_LIMIT))
    columns = ["changed_symbols", "changed_files", "total_direct", "potential", "affected_tests", "deepest"]
    return row.select(*columns, why.isNotNull().alias("truncated"), why.alias("truncated_reason"), "unresolved", "external")


def paths(nodes: DataFrame, limit: int = v.LIMITS["impact_paths"]) -> DataFrame:
    """The path of evidence to each affected node, nearest first."""
    return nodes.where("depth > 0").orderBy("depth", "name", "node").limit(limit).select("root", F.col("node").alias("target"), F.col("name").alias("target_name"), "depth", "path")


def rendered(nodes: DataFrame, unresolved: DataFrame, external: DataFrame, most: int = v.LIMITS["impact_nodes"]) -> DataFrame:
    """One row of six ordered arrays of ``most`` entries at most: changed symbols, changed files, affected nodes, affected tests,
    unresolved and external edges."""
    direct, test = F.col("impact_class") == "DIRECT", F.col("is_test")
    part = F.when(direct, F.when(F.col("node_type") == "SYMBOL", "changed_symbols").otherwise("changed_files")).otherwise(F.when(test, "tests").otherwise("potential"))
    shown = nodes.select(part.alias("part"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("name", F.lit("")).alias("name"), "node", "via")
    lists = first_listed(shown, ["part"], ["depth", "file_path", "name", "node"], F.struct("depth", "file_path", "name", "node", "via"), most)
    main = lists.agg(*[F.coalesce(F.max_by(F.when(F.col("part") == n, F.col("entries")), F.col("part") == n), F.expr(f"cast(array() AS {dict(lists.dtypes)['entries']})")).alias(n) for n in ("changed_symbols", "changed_files", "potential", "tests")])  # four rows
    edge = ["evidence_file_id", "start_line", "evidence"]

    def ends(df: DataFrame, name: str) -> DataFrame:
        listed = first_listed(df.select(F.lit(1).alias("part"), *edge), ["part"], edge, F.struct(*edge), most)
        return listed.agg(F.coalesce(F.first("entries"), F.expr(f"cast(array() AS {dict(listed.dtypes)['entries']})")).alias(name))

    return main.crossJoin(ends(unresolved, "unresolved")).crossJoin(ends(external, "external"))  # one row each
