"""Repositories in a folder of Parquet tables, one partition a repository: what a service's endpoints call, each a plan over these tables.

A step writes whole partitions, so a step that is run again replaces its own rows. What belongs to a diff (its tables, its impact to a
depth, its checklist) is published as one result, see ``publication``; updates of checklists are appended to a log, of which the last
wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as s
from .functions import values as v
from .operators import lines as text
from .operators.lineage import saved
from .plans import context, diff, extract, impact, linediff, listing, resolve, review, search, similar
from .publication import Results, StatusLog, Unpublished
from .sources import files as sources

OWNED = ["files", "symbols", "imports", "exports", "parsed", "relationships"]
PUBLISHED = ["diffs", "impact", "reviews", "log"]
DEPTH = 2


class Missing(LookupError):
    """No such row."""


class Workspace:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.results = Results(spark, f"{self.root}/results")

    # tables

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, repository_id: int) -> DataFrame:
        if not self._exists(f"{self.root}/{name}/repository_id={repository_id}"):
            raise Missing(f"{name} of repository {repository_id}")
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("repository_id") == repository_id)

    def _write(self, name: str, df: DataFrame, repository_id: int) -> None:
        df.drop("repository_id").write.mode("overwrite").parquet(f"{self.root}/{name}/repository_id={repository_id}")

    # repositories

    def health(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("ok").alias("status"), F.lit(self.spark.version).alias("version"))

    def ingest(self, repository_id: int, url: str, folder: str) -> DataFrame:
        """Read a folder (see ``sources.local_clone``) as the files of a repository; its row."""
        name = self.spark.range(1).select(s.repository_of(F.lit(url)).alias("r")).select("r.owner", "r.name")
        if name.where("name IS NOT NULL").count() == 0:
            raise ValueError(f"not a repository url: {url}")
        files = sources.numbered(sources.discover(self.spark, folder))
        self._write("files", files.withColumn("file_id", F.lit(repository_id << 20).cast("long") + F.col("file_id")), repository_id)
        self._write("repositories", name.withColumns({"url": F.lit(url), "status": F.lit("READY")}), repository_id)
        return self.repository(repository_id)

    def repositories(self, limit: int = 200) -> DataFrame:
        return listing.latest(self.spark.read.parquet(f"{self.root}/repositories"), "repository_id", limit)

    def repository(self, repository_id: int) -> DataFrame:
        return self._read("repositories", repository_id)

    def languages(self, repository_id: int) -> DataFrame:
        return sources.language_shares(self._read("files", repository_id))

    def content(self, repository_id: int, path: str, start: int = 1, end: int = 1 << 30) -> DataFrame:
        return listing.content(self._read("files", repository_id), repository_id, path, start, end)

    def remove(self, repository_id: int) -> None:
        """Drop the partitions of a repository in all tables."""
        for name in [*OWNED, "repositories"]:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/repository_id={repository_id}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        for kind in PUBLISHED:
            self.results.delete(kind, {"repository_id": repository_id})

    # analysis

    def parse(self, repository_id: int) -> DataFrame:
        parsed = extract.parsed(self._read("files", repository_id)).persist()
        self._write("symbols", extract.symbols(parsed), repository_id)
        self._write("imports", extract.imports(parsed), repository_id)
        self._write("exports", extract.exports(parsed), repository_id)
        self._write("parsed", parsed, repository_id)
        parsed.unpersist()
        return self.analysis(repository_id)

    def analysis(self, repository_id: int) -> DataFrame:
        return extract.status_counts(self._read("parsed", repository_id))

    def symbols(self, repository_id: int, **filters) -> DataFrame:
        return listing.symbols(self._read("symbols", repository_id).drop("repository_id"), self._read("files", repository_id), repository_id, **filters)

    def symbol(self, repository_id: int, symbol_id: int) -> DataFrame:
        return self._read("symbols", repository_id).where(F.col("symbol_id") == symbol_id)

    def imports(self, repository_id: int, **filters) -> DataFrame:
        return listing.imports(self._read("imports", repository_id).drop("repository_id"), self._read("files", repository_id), repository_id, **filters)

    def exports(self, repository_id: int, **filters) -> DataFrame:
        return listing.exports(self._read("exports", repository_id).drop("repository_id"), self._read("files", repository_id), repository_id, **filters)

    def build_relationships(self, repository_id: int) -> DataFrame:
        """Build the graph anew; edges by type and status."""
        tables = [self._read(n, repository_id) for n in ("files", "symbols", "imports", "exports")]
        edges = resolve.relationships(tables[0], *(t.drop("repository_id") for t in tables[1:]))
        self._write("relationships", edges.drop("repository_id"), repository_id)
        return resolve.counted(self._read("relationships", repository_id))

    def relationships(self, repository_id: int, **filters) -> DataFrame:
        return listing.relationships(self._read("relationships", repository_id).drop("repository_id"), self._read("symbols", repository_id), self._read("files", repository_id), repository_id, **filters)

    def search(self, repository_id: int, query: str, kind: str = "symbol", **options) -> DataFrame:
        return search.search(self._read("files", repository_id), self._read("symbols", repository_id).drop("repository_id"), query, kind, **options)

    def investigation(self, repository_id: int, symbol_id: int) -> DataFrame:
        return search.investigate(self._read("relationships", repository_id), self._read("symbols", repository_id), self._read("files", repository_id), symbol_id)

    def definition(self, repository_id: int, symbol_id: int) -> DataFrame:
        """The symbol of an investigation, with its path and parent."""
        return search.definitions(self.symbol(repository_id, symbol_id).drop("repository_id"), self._read("symbols", repository_id), self._read("files", repository_id))

    def related_files(self, repository_id: int, symbol_id: int) -> DataFrame:
        """Paths around a symbol with their numbers of symbols and relationships."""
        files = self._read("files", repository_id)
        own = self.symbol(repository_id, symbol_id).join(files, "file_id").select("path").limit(1).collect()
        paths = search.related_files(self.investigation(repository_id, symbol_id), files, own=own[0]["path"] if own else None)
        return listing.file_counts(files.join(paths, "path", "left_semi"), self._read("symbols", repository_id), self._read("relationships", repository_id))

    def neighbours(self, repository_id: int, symbol_id: int, limit: int = 200, offset: int = 0) -> DataFrame:
        return listing.neighbours(self._read("relationships", repository_id), symbol_id, limit, offset)

    # changes

    def _key(self, repository_id: int, diff_id: int, depth: int | None = None) -> dict[str, int]:
        return {"repository_id": repository_id, "diff_id": diff_id} | ({} if depth is None else {"depth": depth})

    def _of(self, kind: str, table: str, *key: int) -> DataFrame:
        try:
            return self.results.read(kind, self._key(*key), table)
        except Unpublished as e:
            raise Missing(str(e)) from e

    def compare(self, repository_id: int, diff_id: int, changes: DataFrame, diffs: DataFrame, ends: tuple[str, str] | None = None) -> DataFrame:
        """``changes`` (path, old_path, code, additions, deletions) and ``diffs`` (path, diff) as a diff; its totals. All its tables are
        published at once."""
        files = self._read("files", repository_id)
        counts = changes.select("path", F.col("additions").cast("string"), F.col("deletions").cast("string"))

        def made() -> dict[str, DataFrame]:
            known = saved(diff.linked(diff.numstat(changes.select("path", "old_path", "code"), counts), files))
            ids = known.select("path", F.coalesce("new_file_id", "old_file_id").alias("file_id"))
            numbered = saved(text.hunks(diffs.join(ids, "path"), ["file_id"]))
            diff.checked(known, numbered, diffs=diffs)
            lines = text.changed_lines(numbered)
            return {"files": known, "hunks": diff.stored_hunks(numbered), "lines": lines, "symbols": diff.mapped_symbols(lines, self._read("symbols", repository_id))}

        key = self._key(repository_id, diff_id)
        if ends:
            self.results.ensure("diffs", key, made)
        else:
            self.results.replace("diffs", key, made)
        return self.diff(repository_id, diff_id)

    def compare_revisions(self, repository_id: int, base: str, head: str, changes: DataFrame, diffs: DataFrame) -> int:
        """The diff between two resolved revisions: its number, which they alone decide. It is made once; equal ends are refused."""
        diff_id = diff.identity(repository_id, base, head)
        self.compare(repository_id, diff_id, changes, diffs, (base, head))
        return diff_id

    def compare_snapshots(self, repository_id: int, base: DataFrame, head: DataFrame) -> int:
        """The diff between two snapshots (path, content), without a version control system: renames by what files have in common, hunks
        by patience. Revisions are named by content, so equal snapshots are refused."""
        base, head = saved(base.select("path", "content")), saved(head.select("path", "content"))
        ends = diff.snapshot_revision(base), diff.snapshot_revision(head)
        diff_id = diff.identity(repository_id, *ends)
        found = saved(similar.renames(diff.snapshot_diff(base, head), base, head))
        old = found.select("path", F.coalesce("old_path", "path").alias("_old")).join(base.withColumnRenamed("path", "_old"), "_old", "left").select("path", "content")
        new = found.select("path").join(head, "path", "left")
        scripted = saved(linediff.script(old, new))
        count = lambda mark: F.count_if((F.col("mark") == mark) & ~((F.col("line") == "") & F.col("_alone")))
        alone = scripted.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
        counts = scripted.join(alone, "path").withColumn("_alone", F.col("_n") == 1).groupBy("path").agg(count("+").alias("additions"), count("-").alias("deletions"))
        code = F.element_at(F.create_map(*[F.lit(x) for kv in {"ADDED": "A", "DELETED": "D", "MODIFIED": "M", "RENAMED": "R", "COPIED": "C"}.items() for x in kv]), F.col("status"))
        changes = found.join(counts, "path", "left").select("path", "old_path", code.alias("code"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))
        self.compare(repository_id, diff_id, changes, linediff.diff_texts(linediff.unified(scripted)), ends)
        return diff_id

    def diff(self, repository_id: int, diff_id: int) -> DataFrame:
        return diff.totals(self.diff_files(repository_id, diff_id), self.diff_symbols(repository_id, diff_id))

    def diff_files(self, repository_id: int, diff_id: int) -> DataFrame:
        return diff.in_order(files=self._of("diffs", "files", repository_id, diff_id))[0]

    def diff_symbols(self, repository_id: int, diff_id: int) -> DataFrame:
        return diff.in_order(symbols=self._of("diffs", "symbols", repository_id, diff_id))[0]

    def diff_file(self, repository_id: int, diff_id: int, file_id: int) -> DataFrame:
        return diff.in_order(lines=self._of("diffs", "lines", repository_id, diff_id).where(F.col("file_id") == file_id))[0]

    def diff_hunks(self, repository_id: int, diff_id: int, file_id: int) -> DataFrame:
        return diff.in_order(hunks=self._of("diffs", "hunks", repository_id, diff_id).where(F.col("file_id") == file_id))[0]

    def analyse_impact(self, repository_id: int, diff_id: int, depth: int = DEPTH) -> DataFrame:
        """The impact of a diff to a depth, made once: results of other depths stand beside it."""
        files, symbols, edges = (self._read(n, repository_id) for n in ("files", "symbols", "relationships"))
        edges, symbols = edges.drop("repository_id"), symbols.drop("repository_id")

        def made() -> dict[str, DataFrame]:
            roots = saved(impact.roots(self._of("diffs", "symbols", repository_id, diff_id), self._of("diffs", "files", repository_id, diff_id), files))
            nodes = impact.traversed(roots, edges, symbols, files, depth).join(roots.select("node", "file_level"), "node", "left")
            nodes = saved(nodes.withColumns({"file_level": F.coalesce("file_level", F.lit(False)), "category": s.file_category(F.col("file_path"))}))
            ends = [impact.open_ends(roots, edges, status) for status in ("UNRESOLVED", "EXTERNAL")]
            return {"nodes": nodes, "open": ends[0].unionByName(ends[1]), "paths": impact.paths(nodes)}

        self.results.ensure("impact", self._key(repository_id, diff_id, depth), made)
        return self.impact(repository_id, diff_id, depth)

    def _open(self, repository_id: int, diff_id: int, status: str, depth: int = DEPTH) -> DataFrame:
        return self._of("impact", "open", repository_id, diff_id, depth).where(F.col("status") == status)

    def impact(self, repository_id: int, diff_id: int, depth: int = DEPTH) -> DataFrame:
        return impact.rendered(self._of("impact", "nodes", repository_id, diff_id, depth), self._open(repository_id, diff_id, "UNRESOLVED", depth), self._open(repository_id, diff_id, "EXTERNAL", depth))

    def impact_summary(self, repository_id: int, diff_id: int, depth: int = DEPTH) -> DataFrame:
        return impact.summary(self._of("impact", "nodes", repository_id, diff_id, depth), self._open(repository_id, diff_id, "UNRESOLVED", depth), self._open(repository_id, diff_id, "EXTERNAL", depth))

    # checklists

    def make_review(self, repository_id: int, diff_id: int, depth: int = DEPTH) -> DataFrame:
        """The checklist of a diff; made again, it keeps the state that it had, which stays readable until the new one is there."""
        nodes = self._of("impact", "nodes", repository_id, diff_id, depth)
        ends = self._of("impact", "open", repository_id, diff_id, depth).select(
            F.concat_ws(":", "owner", "type", F.col("start_line").cast("string")).alias("node"), F.lit("SYMBOL").alias("node_type"), F.col("evidence").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("category"),
            F.col("status").alias("impact_class"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("is_test"), F.lit(False).alias("file_level"),
        )

        def made() -> dict[str, DataFrame]:
            new = review.items(nodes.select(*ends.columns).unionByName(ends), self._of("impact", "paths", repository_id, diff_id, depth))
            try:
                return {"items": review.carried(new, self.review(repository_id, diff_id))}
            except Missing:
                return {"items": new.withColumns({"status": F.lit("OPEN"), "notes": F.lit("")})}

        self.results.replace("reviews", self._key(repository_id, diff_id), made)
        return self.review(repository_id, diff_id)

    def _log(self, repository_id: int, diff_id: int) -> StatusLog:
        return StatusLog(self.results, self._key(repository_id, diff_id), v.ITEM_STATES, v.ENTRY_STATES, v.NOTE_CHARS)

    def update_item(self, repository_id: int, diff_id: int, stable_key: str, status: str, notes: str = "", entry_key: str | None = None) -> None:
        """Append the state of an item, or of one of its entries."""
        row = self.spark.range(1).select(F.lit(stable_key).alias("stable_key"), F.lit(entry_key).cast("string").alias("entry_key"), F.lit(status).alias("status"), s.redact_text(F.lit(notes)).alias("notes"))
        self.update_items(repository_id, diff_id, row)

    def update_items(self, repository_id: int, diff_id: int, updates: DataFrame) -> int:
        """Append states (stable_key, entry_key, status, notes); Refused if one is of no item or no state."""
        items = self._of("reviews", "items", repository_id, diff_id)
        known = items.select("stable_key", F.lit(None).cast("string").alias("entry_key")).unionByName(items.select("stable_key", F.explode("entries.entry_key").alias("entry_key")))
        return self._log(repository_id, diff_id).append(updates, known)

    def compact_log(self, repository_id: int, diff_id: int) -> dict:
        """Fold the updates of a checklist into a snapshot."""
        return self._log(repository_id, diff_id).compact()

    def review(self, repository_id: int, diff_id: int) -> DataFrame:
        items = self._of("reviews", "items", repository_id, diff_id)
        log = self._log(repository_id, diff_id).latest()
        items = review.updated(items, log.where("entry_key IS NULL"))
        told = log.where("entry_key IS NOT NULL").groupBy("stable_key").agg(F.map_from_entries(F.collect_list(F.struct("entry_key", "status"))).alias("known"))  # an item has 200 entries at most
        state = lambda e: e.withField("status", F.coalesce(F.try_element_at("known", e["entry_key"]), e["status"]))
        return items.join(told, "stable_key", "left").withColumn("entries", F.transform("entries", state)).drop("known").orderBy("sort", "stable_key")

    def review_counters(self, repository_id: int, diff_id: int) -> DataFrame:
        items = self.review(repository_id, diff_id)
        return review.counters(items).crossJoin(review.summary_text(items))  # one row each

    def recent(self) -> DataFrame:
        tables = {"repository": (self.spark.read.parquet(f"{self.root}/repositories"), "repository_id")}
        for kind, name in (("diff", "diffs"), ("review", "reviews")):
            keys = self.results.keys(name, 2)
            if "diff_id" in keys.columns:
                tables[kind] = (keys.select("diff_id"), "diff_id")
        return listing.recent(tables)

    def lens(self, repository_id: int, diff_id: int, kind: str, path: str | None = None, depth: int = DEPTH) -> DataFrame:
        """Evidence of a change, its impact, its review or what is unresolved, cut to the budget of a context and redacted."""
        of = lambda table: self._of("impact", table, repository_id, diff_id, depth)
        if kind == "change":
            paths = self._read("files", repository_id).select("file_id", "path")
            parts = {n: self._of("diffs", n, repository_id, diff_id) for n in ("files", "lines", "symbols")}
            rows = context.of_change(parts["files"], parts["lines"].join(paths, "file_id"), parts["symbols"].join(paths, "file_id"), path)
        elif kind == "impact":
            rows = context.of_impact(of("nodes"), self._open(repository_id, diff_id, "EXTERNAL", depth), of("paths"))
        elif kind == "review":
            rows = context.of_review(self.review(repository_id, diff_id))
        elif kind == "unresolved":
            rows = context.of_unresolved(self._open(repository_id, diff_id, "UNRESOLVED", depth), of("paths"))
        else:
            raise ValueError(f"unknown lens {kind}")
        return review.context(rows)
