"""Source files of repositories as rows."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions import values as v
from ..operators import relational

MAX_FILE_BYTES, MAX_FILES, MAX_REPOSITORY_BYTES = 512 << 10, 10_000, 200 << 20


class LimitExceeded(ValueError):
    """A repository is larger than allowed."""


def read_files(spark: SparkSession, root: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path (below ``root``), language, size_bytes, line_count, content; ignored folders and files are left out, and
    content is null where a file is over the size limit. Malformed UTF-8 is replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/").split("://")[-1].rstrip("/") + "/"), "^[a-z0-9]+:/*", "/")
    whole = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    # the source skips files by length before it opens them, and reads no content that is not selected
    small = raw.where(F.col("length") <= max_file_bytes).select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    large = raw.where(F.col("length") > max_file_bytes).select("path", "length", F.lit(None).cast("string").alias("content"))
    kept = small.union(large).withColumns({"p": whole, "b": base}).withColumn("path", F.expr("substring(p, locate(b, p) + length(b))"))
    kept = kept.where(~s.is_ignored(F.col("path")) & s.is_contained(F.col("path")))
    out = kept.select("path", s.language_of(F.col("path")).alias("language"), F.col("length").cast("int").alias("size_bytes"), "content")
    return out.withColumn("line_count", F.coalesce(s.line_count(F.col("content")), F.lit(0)))


def _entries(spark: SparkSession, root: str, max_files: int, max_bytes: int) -> list[tuple[str, str, int]]:
    """(location, path below root, bytes) of the files of one repository by path, or LimitExceeded as soon as there are too many or they
    are too large. Ignored folders are not entered, links to folders not followed, and links to what lies outside left out. Files are
    listed, not opened, in the file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = system.resolvePath(at)
    local = system.getScheme() == "file"
    real = lambda p: jvm.java.io.File(p.toUri().getPath()).getCanonicalPath() if local else p.toUri().getPath()
    inside, found, size, todo = real(top), [], 0, [("", top)]
    while todo:
        prefix, folder = todo.pop()
        for entry in system.listStatus(folder):
            where, name = entry.getPath(), entry.getPath().getName()
            link = local and jvm.java.nio.file.Files.isSymbolicLink(jvm.java.io.File(where.toUri().getPath()).toPath())
            if entry.isDirectory():
                if not link and name not in v.IGNORED_DIRECTORIES:
                    todo.append((f"{prefix}{name}/", where))
                continue
            if name in v.IGNORED_FILES or (link and not f"{real(where)}/".startswith(f"{inside}/")):
                continue
            size += entry.getLen()
            found.append((where.toString(), f"{prefix}{name}", entry.getLen()))
            if len(found) > max_files or size > max_bytes:
                raise LimitExceeded(f"over {max_files} files or {max_bytes} bytes in {root}")
    return sorted(found, key=lambda f: f[1])


def discover(spark: SparkSession, root: str, max_file_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES, max_bytes: int = MAX_REPOSITORY_BYTES) -> DataFrame:
    """What ``read_files`` gives, of one repository: the listing stops at the limits, before any content is read, and bounds what the
    driver holds; then executors read the files that are small enough."""
    found = _entries(spark, root, max_files, max_bytes)
    listed = spark.createDataFrame([(w, p, n) for w, p, n in found], "location string, path string, length long")
    small = [w for w, _, n in found if n <= max_file_bytes]
    columns = ["path", s.language_of(F.col("path")).alias("language"), F.col("length").cast("int").alias("size_bytes")]
    if not small:
        return listed.select(*columns, F.lit(None).cast("string").alias("content"), F.lit(0).alias("line_count"))
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    texts = spark.read.format("binaryFile").load(small).select(plain("path").alias("_at"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    out = listed.withColumn("_at", plain("location")).join(texts, "_at", "left").select(*columns, "content")
    return out.withColumn("line_count", F.coalesce(s.line_count(F.col("content")), F.lit(0)))


def _git(folder: str | None, *args: str) -> str:
    """What git prints. It runs on the driver, before any job, and never runs code of the repository."""
    at = ["-C", folder] if folder else []
    return subprocess.run(["git", *at, "-c", "core.quotepath=off", *args], check=True, capture_output=True, text=True, timeout=300, errors="replace").stdout


def local_clone(path: str, destination: str, revision: str | None = None) -> tuple[str, str]:
    """A shallow clone of a local repository for ``read_files``; (branch, commit)."""
    _git(None, "clone", "-q", "--depth", "1", "--single-branch", *(["--branch", revision] if revision else []), "--", f"file://{path}", destination)
    return _git(destination, "rev-parse", "--abbrev-ref", "HEAD").strip(), _git(destination, "rev-parse", "HEAD").strip()


def resolved_revision(folder: str, revision: str | None) -> str:
    """The commit of a revision (of HEAD for none), or ValueError for a name that is not allowed or not there."""
    name = revision or "HEAD"
    if not re.match(v.REVISION, name) or ".." in name or len(name) > 128:
        raise ValueError(f"invalid revision: {name!r}")
    try:
        return _git(folder, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}").strip()
    except subprocess.CalledProcessError as e:
        raise ValueError(f"no such revision: {name!r}") from e


def git_changes(spark: SparkSession, folder: str, base: str, head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes: path, old_path, code, additions, deletions), (diffs: path, diff with three lines of context) between two revisions."""
    ends = [resolved_revision(folder, base), resolved_revision(folder, head)]
    counts = {}
    for row in _git(folder, "diff", "--numstat", "-M", "-C", *ends).splitlines():
        added, deleted, path = row.split("\t", 2)
        new = re.sub(r"\{.*? => (.*?)\}", r"\1", path).replace("//", "/") if "{" in path else path.split(" => ")[-1]
        counts[new] = (added, deleted)
    rows = []
    for row in _git(folder, "diff", "--name-status", "-M", "-C", *ends).splitlines():
        code, *paths = row.split("\t")
        rows.append((paths[-1], paths[0] if len(paths) > 1 else None, code, *counts.get(paths[-1], ("0", "0"))))
    texts = [(r[0], _git(folder, "diff", "--unified=3", "-M", *ends, "--", *[p for p in r[:2] if p])) for r in rows]
    return spark.createDataFrame(rows, "path string, old_path string, code string, additions string, deletions string"), spark.createDataFrame(texts, "path string, diff string")


def checked(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_REPOSITORY_BYTES) -> DataFrame:
    """``files``, or LimitExceeded."""
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b")).collect()[0]
    if row["n"] > max_files or (row["b"] or 0) > max_bytes:
        raise LimitExceeded(f"{row['n']} files, {row['b']} bytes")
    return files


def numbered(files: DataFrame) -> DataFrame:
    """file_id by (repository and) path: dense, from 1, the same on every run."""
    return relational.numbered(files, "file_id", [c for c in ("repository_id", "path") if c in files.columns])


def language_shares(files: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope,) language, bytes, share of all bytes (of the scope) in percent; largest first."""
    from pyspark.sql import Window

    sums = files.where("language IS NOT NULL").groupBy(*(scope or []), "language").agg(F.sum("size_bytes").alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy(*(scope or [F.lit(0)])))  # one row a language
    return sums.withColumn("share", s.share(F.col("bytes"), whole)).orderBy(*(scope or []), F.desc("bytes"), "language")


def write_table(df: DataFrame, path: str, partition_by: str = "repository_id") -> None:
    """Replace the partitions that ``df`` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def without_repository(tables: dict[str, DataFrame], repository_id: int) -> dict[str, DataFrame]:
    """All tables without the rows of one repository: by its id, or by the rows of the table that they belong to. A table names its
    owner by the first of its ``*_id`` columns that another table is keyed by."""
    gone: dict[str, DataFrame] = {}
    out = {}
    for name, table in tables.items():  # owners come before what they own
        key = f"{name.removesuffix('s')}_id"
        owner = next((o for o in gone if o in table.columns and o != key), None)
        if "repository_id" in table.columns:
            mine = F.col("repository_id") == repository_id
            out[name], removed = table.where(~mine | F.col("repository_id").isNull()), table.where(mine)
        elif owner:
            out[name], removed = table.join(gone[owner], owner, "left_anti"), table.join(gone[owner], owner, "left_semi")
        else:
            out[name] = table
            continue
        if key in table.columns:
            gone[key] = removed.select(key)
    return out
