"""Evidence for explaining a change, its impact or a checklist: ordered rows (section, kind, name, text, place) that ``review.context``
cuts to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..operators import relational as rel

NODES, EXTERNALS, PATHS, ENTRIES = 30, 10, 6, 3
SELECTED = 6


def line_text(side: Column, number: Column, text: Column) -> Column:
    """``+ 12: text`` of an added line, ``- 12: text`` of a deleted one."""
    return F.concat(F.when(side == "NEW", "+ ").otherwise("- "), number.cast("string"), F.lit(": "), text)


def changed_text(changed: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> text: the changed lines of each, by line and side."""
    rows = F.array_sort(F.collect_list(F.struct("line_number", "side", line_text(F.col("side"), F.col("line_number"), F.col("text")).alias("t"))))
    return changed.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"))


def _rows(df: DataFrame, section: int, kind: str | Column, name: str | Column, text: Column, order: list[Column | str]) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    # the order as one column: numbers are padded, so that they sort as numbers
    place = F.concat_ws("/", *[F.lpad(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")).cast("string"), 24, " ") for c in order])
    return df.select(F.lit(section).alias("section"), lit(kind).alias("kind"), lit(name).alias("name"), text.alias("text"), place.alias("sub"))


def ordered(parts: list[DataFrame]) -> DataFrame:
    """All parts with their place: by section, then inside it."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("place", F.concat(F.lpad(F.col("section").cast("string"), 2, "0"), F.lit("/"), "sub")).drop("section", "sub")


def of_change(changes: DataFrame, changed: DataFrame, mapped: DataFrame, path: str | None = None) -> DataFrame:
    """Changed files (path, status, additions, deletions), their lines (path, side, line_number, text) and symbols (path, name,
    change_type), of one file if a path is given."""
    only = (lambda d: d) if path is None else (lambda d: d.where(F.col("path") == path))
    files, lines, symbols = only(changes), only(changed), only(mapped)
    return ordered([
        _rows(files, 0, "file", F.col("path"), F.concat_ws(" ", "path", "status", F.concat(F.lit("+"), "additions"), F.concat(F.lit("-"), "deletions")), ["path"]),
        _rows(changed_text(lines, ["path"]), 1, "hunk", F.col("path"), F.col("text"), ["path"]),
        _rows(symbols, 2, "symbol", F.col("name"), F.concat_ws(" ", "name", "change_type"), ["path", "name"]),
    ])


def of_impact(nodes: DataFrame, external: DataFrame, paths: DataFrame) -> DataFrame:
    """The nearest nodes of each class, external names and paths."""
    near = rel.top_k(nodes, ["impact_class"], ["depth", "name", "node"], NODES)
    out = rel.top_k(external.select("evidence").distinct().withColumn("all", F.lit(1)), ["all"], ["evidence"], EXTERNALS)
    ways = rel.top_k(paths.withColumn("all", F.lit(1)), ["all"], ["depth", "target"], PATHS)
    steps = F.array_join(F.transform("path", lambda p: F.concat_ws(" ", p["target"], p["kind"], p["source"])), "; ")
    return ordered([
        _rows(near, 0, F.lower("impact_class"), F.col("name"), F.concat_ws(" ", "name", F.coalesce("via", F.lit("changed")), F.concat(F.lit("depth "), "depth")), ["impact_class", "rank"]),
        _rows(out, 1, "external", F.col("evidence"), F.col("evidence"), ["rank"]),
        _rows(ways, 2, "path", F.col("target"), steps, ["rank"]),
    ])


def of_review(items: DataFrame) -> DataFrame:
    """The items, and the first entries of those that are unresolved."""
    entries = items.where("item_type = 'UNRESOLVED_IMPACT'").select("sort", F.posexplode(F.slice("entries", 1, ENTRIES)).alias("at", "e"))
    return ordered([
        _rows(items, 0, F.lower("item_type"), F.col("stable_key"), F.concat_ws(" ", "priority", "title"), ["sort", "stable_key"]),
        _rows(entries, 1, "entry", F.col("e.entry_key"), F.col("e.title"), ["sort", "at"]),
    ])


def of_unresolved(open_ends: DataFrame, paths: DataFrame) -> DataFrame:
    """Open ends, and the paths that reach their owners."""
    ways = paths.join(open_ends.select(F.col("owner").alias("target")).distinct(), "target", "left_semi")
    return ordered([
        _rows(open_ends, 0, "unresolved", F.col("evidence"), F.concat_ws(" ", "type", "evidence"), ["evidence_file_id", "start_line", "evidence"]),
        _rows(ways, 1, "path", F.col("target"), F.concat_ws(" ", "root", F.lit("to"), "target"), ["depth", "target"]),
    ])


def identified(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence with the node that its class, type and name stand for (the first of several)."""
    known = rel.first_wins(nodes.select("impact_class", "node_type", "name", "node"), ["impact_class", "node_type", "name"], ["node"])
    return evidence.join(known, ["impact_class", "node_type", "name"], "left")


def selected(evidence: DataFrame, chosen: DataFrame, most: int = SELECTED) -> DataFrame:
    """``chosen`` (key, indices) -> the evidence (index, ...) of each key's indices, in their order; unknown ones go, then the first stay."""
    asked = chosen.select("key", F.posexplode("indices").alias("at", "index"))
    return rel.top_k(asked.join(evidence, "index"), ["key"], ["at"], most).drop("at")


def audited(log_path: str, rows: DataFrame) -> None:
    """Append what was asked (not what was sent) with the digest of the context."""
    rows.select("kind", "subject_id", s.digest(text=F.col("context")).alias("context_digest"), F.current_timestamp().alias("at")).write.mode("append").parquet(log_path)
