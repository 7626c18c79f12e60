"""Prioritised review checklists from impact nodes, and bounded context for explaining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions import values as v
from ..operators import relational as rel


STEPS = "array<struct<source: string, relationship: string, target: string, evidence: string>>"


def path_steps(paths: DataFrame) -> DataFrame:
    """target_name, path_steps: the shortest path to each name (see ``impact.paths``), as steps from the changed node outward, with the
    names of ``paths`` where it has them."""
    step = lambda p: F.struct(p["target"].alias("source"), p["kind"].alias("relationship"), p["source"].alias("target"), p["at"].alias("evidence"))
    return shortest_paths(paths).select("target_name", F.transform("path", step).cast(STEPS).alias("path_steps"))


def items(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``nodes`` (node, node_type, name, file_path, category, impact_class, depth, via, is_test, file_level) -> stable_key,
    item_type, via, priority, sort, title, total, note, entries. One item a changed symbol; all else is grouped. An item lists its first
    200 entries, each with the steps of the shortest path to its name, if ``paths`` are given; titles are redacted."""
    if paths is not None:
        nodes = nodes.join(path_steps(paths).withColumnRenamed("target_name", "name"), "name", "left")
    else:
        nodes = nodes.withColumn("path_steps", F.lit(None).cast(STEPS))
    changed = (F.col("impact_class") == "DIRECT") & (F.col("node_type") == "SYMBOL")
    file_level = (F.col("impact_class") == "DIRECT") & (F.col("node_type") == "FILE") & F.col("file_level")
    potential = F.col("impact_class") == "POTENTIAL"
    kind = (
        F.when(changed, "CHANGED_CODE")
        .when(file_level & (F.col("category") == "CONFIG"), "CONFIGURATION_CHANGE")
        .when(file_level & (F.col("category") == "DOCUMENTATION"), "DOCUMENTATION_CHANGE")
        .when(file_level, "CHANGED_CODE")
        .when(potential & F.col("is_test"), "AFFECTED_TEST")
        .when(potential & F.col("via").isin(v.BEHAVIOUR), "AFFECTED_CALLER")
        .when(potential, "AFFECTED_DEPENDENCY")
        .when(F.col("impact_class") == "UNRESOLVED", "UNRESOLVED_IMPACT")
        .when(F.col("impact_class") == "EXTERNAL", "EXTERNAL_DEPENDENCY")
    )
    direct = F.col("depth") <= 1
    group = F.when(changed, F.col("node")).when(F.col("item_type") == "AFFECTED_CALLER", F.concat_ws("/", "via", F.when(direct, "direct").otherwise("transitive"))).when(F.col("item_type") == "AFFECTED_DEPENDENCY", F.col("via")).otherwise("all")
    typed = nodes.withColumn("item_type", kind).where("item_type IS NOT NULL").withColumn("group_key", F.coalesce(group, F.lit("all")))
    grouped = typed.groupBy("item_type", "group_key").agg(
        F.count(F.lit(1)).alias("total"), F.min("via").alias("via"), F.min(direct).alias("all_direct"), F.min("name").alias("first_name"), F.min("file_path").alias("first_path"),
    )
    entry = F.struct(s.redact_text(F.col("name")).alias("title"), F.col("node").alias("entry_key"), "file_path", F.coalesce("path_steps", F.array().cast(STEPS)).alias("path_steps"), F.lit("OPEN").alias("status"))
    grouped = grouped.join(rel.first_listed(typed, ["item_type", "group_key"], ["depth", "name", "node"], entry, v.LIMITS["review_entries"]), ["item_type", "group_key"])
    grouped = grouped.withColumn("priority", s.item_priority(F.col("item_type"), F.coalesce("via", F.lit("")), F.col("all_direct")))
    # items of one priority follow each other, so those beyond the limit can't be among the first
    place = F.row_number().over(Window.partitionBy("item_type", "priority").orderBy("first_path", "first_name", "group_key"))
    grouped = grouped.withColumn("_place", place).where(F.col("_place") <= v.LIMITS["review_items"]).drop("_place")
    place = F.row_number().over(Window.partitionBy("item_type").orderBy("first_path", "first_name", "group_key")) - 1
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in v.RELATION_LABELS.items() for x in kv]), F.col("via")), F.lit("items"))
    title = F.when((F.col("item_type") == "CHANGED_CODE") & (F.col("group_key") != "all"), F.concat(F.lit("Review changed "), "first_name")).otherwise(F.concat_ws(" ", F.lit("Check"), F.col("total").cast("string"), label))
    out = grouped.withColumn("sort", s.item_sort(F.col("item_type"), F.col("priority"), place)).withColumn("title", s.redact_text(title)).withColumn("note", cap_note(F.col("total"))).withColumn("stable_key", F.concat_ws(":", "item_type", "group_key"))
    return out.select("stable_key", "item_type", "via", "priority", "sort", "title", "total", "note", "entries").orderBy("sort", "stable_key").limit(v.LIMITS["review_items"])


def cap_note(total: Column, limit: int = v.LIMITS["review_entries"]) -> Column:
    """What a cut list says of the rest; empty where nothing is cut."""
    return F.when(total > limit, F.format_string("Showing the first %d of %d entries.", F.lit(limit), total)).otherwise("")


def summary_text(checklist: DataFrame) -> DataFrame:
    """title and summary of a checklist, one row."""
    n = checklist.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("priority") == "REQUIRED").alias("required"), F.count_if(F.col("priority") == "RECOMMENDED").alias("recommended"))
    return n.select(F.format_string("Review checklist (%d items)", "n").alias("title"), F.format_string("%d required and %d recommended of %d items", "required", "recommended", "n").alias("summary"))


def shortest_paths(paths: DataFrame) -> DataFrame:
    """The shortest path to each target name, then the first root."""
    return rel.first_wins(paths, ["target_name"], ["depth", "root", "target"])


def updated(checklist: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the last status and notes of an append-only log (stable_key, status, notes, updated_at)."""
    last = latest_status(log, "stable_key").select("stable_key", F.col("status").alias("_status"), F.col("notes").alias("_notes"))
    out = checklist.join(last, "stable_key", "left")
    return out.withColumns({"status": F.coalesce("_status", "status"), "notes": F.coalesce("_notes", "notes")}).drop("_status", "_notes")


def carried(new: DataFrame, previous: DataFrame) -> DataFrame:
    """The checklist with the state of an earlier one: of items by key, of entries by entry key across all items."""
    out = rel.carried_over(new, previous, "stable_key", {"status": "OPEN", "notes": ""})
    old = previous.select(F.explode("entries").alias("e")).groupBy(F.col("e.entry_key").alias("entry_key")).agg(F.max("e.status").alias("old_status"))
    each = out.select("stable_key", F.posexplode("entries").alias("at", "e")).withColumn("entry_key", F.col("e.entry_key")).join(old, "entry_key", "left")
    merged = each.withColumn("e", F.col("e").withField("status", F.coalesce("old_status", F.lit("OPEN"))))
    merged = merged.groupBy("stable_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("entries"))
    return out.drop("entries").join(merged, "stable_key", "left")


def counters(checklist: DataFrame) -> DataFrame:
    """Items by priority and by status."""
    by = lambda c, x: F.count_if(F.col(c) == x).alias(x.lower())
    return checklist.agg(F.count(F.lit(1)).alias("items"), *[by("priority", p) for p in v.PRIORITY_ORDER], *[by("status", x) for x in ("OPEN", "DONE", "SKIPPED")])


def latest_status(log: DataFrame, key: str = "item_id", at: str = "updated_at") -> DataFrame:
    """The state of each item from an append-only log of updates: the last wins."""
    return rel.last_wins(log, [key], at)


def context(evidence: DataFrame, budget: int = v.LIMITS["context_chars"], most: int = v.LIMITS["context_items"], per_kind: int = 30) -> DataFrame:
    """``evidence`` (kind, place, text) -> the leading rows that fit a character budget, redacted, with a digest each."""
    clean = evidence.withColumn("text", F.substring(s.redact_text(F.col("text")), 1, 800))
    few = rel.top_k(clean, ["kind"], ["place"], per_kind).drop("rank").orderBy("place").limit(most)
    fitting = rel.within_budget(few.withColumn("cost", F.length("text")), "cost", ["place"], budget)
    return fitting.select("kind", "place", "text", "running_cost", s.digest(kind=F.col("kind"), place=F.col("place"), text=F.col("text")).alias("digest"))
