"""Results of several tables that appear as one, and logs that are folded into snapshots.

A result is a folder ``<kind>/<key>=<value>/...`` with the tables of each version under ``data/<version>`` and numbered records. Tables
are written first, the record last, by creating a file that must not exist yet: so a job that dies before leaves nothing that a reader
sees, readers always see all tables of one version, and of two writers of one record one wins. The file system has to create files
exclusively, as HDFS and local ones do. Versions that no reader needs any more are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.relational import first_wins, last_wins

Key = Mapping[str, int | str]
Tables = Mapping[str, DataFrame]


class Unpublished(LookupError):
    """There is no such result."""


class Results:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, system = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []

    def folder(self, kind: str, key: Key) -> str:
        return "/".join([self.root, kind, *[f"{k}={v}" for k, v in key.items()]])

    def _create(self, path: str, text: str) -> bool:
        """Create a file with ``text``; False if there is one."""
        at, system = self._at(path)
        try:
            out = system.create(at, False)
        except Exception as e:
            if system.exists(at):
                return False
            raise e
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def delete(self, kind: str, key: Key) -> None:
        at, system = self._at(self.folder(kind, key))
        system.delete(at, True)

    # records

    def _record(self, folder: str, name: str) -> dict | None:
        rows = self.spark.read.text(f"{folder}/records/{name}", wholetext=True).collect()  # a file of a line
        try:
            return json.loads(rows[0]["value"]) if rows else None
        except ValueError:  # its writer died while it wrote
            return None

    def current(self, kind: str, key: Key) -> dict | None:
        """The last complete record."""
        folder = self.folder(kind, key)
        for name in reversed([n for n in self._names(f"{folder}/records") if n.endswith(".json")]):
            record = self._record(folder, name)
            if record:
                return record | {"number": int(name.removesuffix(".json"))}
        return None

    def _write(self, kind: str, key: Key, tables: Tables) -> str:
        version = uuid.uuid4().hex[:12]
        for name, df in tables.items():
            df.write.parquet(f"{self.folder(kind, key)}/data/{version}/{name}")
        return version

    def _drop(self, kind: str, key: Key, version: str) -> None:
        at, system = self._at(f"{self.folder(kind, key)}/data/{version}")
        system.delete(at, True)

    def ensure(self, kind: str, key: Key, compute: Callable[[], Tables]) -> dict:
        """The record of a result that depends on its key only: computed unless it is there. Of two that compute it at a time the second
        takes what the first has published."""
        found = self.current(kind, key)
        return found if found else self.replace(kind, key, compute, once=True)

    def replace(self, kind: str, key: Key, compute: Callable[[], Tables], once: bool = False, **more) -> dict:
        """Publish a new version; the old one stays readable until then, for ``compute`` too."""
        tables = compute()
        version = self._write(kind, key, tables)
        record = {"version": version, "tables": sorted(tables)} | dict(key) | more
        number = 1 + max([int(n.removesuffix(".json")) for n in self._names(f"{self.folder(kind, key)}/records") if n.endswith(".json")], default=0)
        while True:
            if once and (found := self.current(kind, key)):
                self._drop(kind, key, version)
                return found
            if self._create(f"{self.folder(kind, key)}/records/{number:010d}.json", json.dumps(record)):
                return record | {"number": number}
            number += 1

    def read(self, kind: str, key: Key, table: str) -> DataFrame:
        record = self.current(kind, key)
        if not record or table not in record["tables"]:
            raise Unpublished(f"{table} of {kind} {dict(key)}")
        return self.spark.read.parquet(f"{self.folder(kind, key)}/data/{record['version']}/{table}")

    def keys(self, kind: str, depth: int) -> DataFrame:
        """The keys (of ``depth`` columns) of all results of a kind, from their records."""
        at, _ = self._at(f"{self.root}/{kind}")
        if not self._names(f"{self.root}/{kind}"):
            return self.spark.createDataFrame([], "version string, number int")
        pattern = "/".join([str(at), *["*"] * depth, "records", "*.json"])
        rows = self.spark.read.option("mode", "DROPMALFORMED").json(pattern).withColumn("number", F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int"))
        named = [c for c in rows.columns if c not in ("version", "tables", "number", "folded", "_corrupt_record")]
        return last_wins(rows.select(*named, "version", "number"), named, "number")

    def vacuum(self, kind: str, key: Key) -> list[str]:
        """Remove the versions that the last record doesn't name."""
        record = self.current(kind, key)
        gone = [n for n in self._names(f"{self.folder(kind, key)}/data") if not record or n != record["version"]]
        for version in gone:
            self._drop(kind, key, version)
        return gone


class Refused(ValueError):
    """An update names what isn't there, or a state that isn't allowed."""


class StatusLog:
    """States of items (stable_key) and of their entries (entry_key): updates are appended as segments, and folded into a snapshot now
    and then. What is read is the last update of each key, from the snapshot and the segments that it doesn't hold."""

    def __init__(self, results: Results, key: Key, item_states: list[str], entry_states: list[str], longest: int = 4000) -> None:
        self.results, self.key = results, key
        self.item_states, self.entry_states, self.longest = item_states, entry_states, longest
        self.tail = results.folder("log", key) + "/tail"

    def append(self, updates: DataFrame, known: DataFrame) -> int:
        """Add ``updates`` (stable_key, entry_key or null, status, notes) if all of ``known`` (stable_key, entry_key or null); how many.
        All are refused if one is of an unknown key or state."""
        rows = updates.select("stable_key", "entry_key", "status", F.substring("notes", 1, self.longest).alias("notes"))
        bad = F.when(F.col("entry_key").isNull(), ~F.col("status").isin(self.item_states)).otherwise(~F.col("status").isin(self.entry_states))
        bad = rows.where(F.col("status").isNull() | bad).limit(1).collect()
        if bad:
            raise Refused(f"state {bad[0]['status']!r}")
        pairs = known.select(F.col("stable_key").alias("_s"), F.col("entry_key").alias("_e")).distinct()
        lost = rows.join(pairs, F.col("stable_key").eqNullSafe(F.col("_s")) & F.col("entry_key").eqNullSafe(F.col("_e")), "left_anti").limit(1).collect()
        if lost:
            raise Refused(f"no item {lost[0]['stable_key']!r}, entry {lost[0]['entry_key']!r}")
        segment = uuid.uuid4().hex[:12]
        rows.withColumn("updated_at", F.current_timestamp()).write.parquet(f"{self.tail}/{segment}")
        return rows.count()

    def _segments(self) -> list[str]:
        return [n for n in self.results._names(self.tail) if "_SUCCESS" in self.results._names(f"{self.tail}/{n}")]

    def _open(self, segments: list[str]) -> DataFrame:
        """The snapshot and ``segments``; a segment's name orders updates of one moment."""
        spark, record = self.results.spark, self.results.current("log", self.key)
        columns = ["stable_key", "entry_key", "status", "notes", "updated_at", "segment"]
        out = spark.createDataFrame([], "stable_key string, entry_key string, status string, notes string, updated_at timestamp, segment string")
        if record:
            out = out.unionByName(self.results.read("log", self.key, "states").select(*columns))
        new = [s for s in segments if not record or s not in record["folded"]]
        if new:
            at = F.regexp_extract(F.input_file_name(), r"/tail/([0-9a-f]+)/", 1)
            out = out.unionByName(spark.read.parquet(*[f"{self.tail}/{s}" for s in new]).withColumn("segment", at).select(*columns))
        return out

    def latest(self) -> DataFrame:
        """stable_key, entry_key, status, notes, updated_at: the last update of each item and entry."""
        return self._last(self._segments()).drop("segment")

    def _last(self, segments: list[str]) -> DataFrame:
        order = [F.negative(F.unix_micros("updated_at")), F.xxhash64("segment"), F.col("status"), F.col("notes")]
        return first_wins(self._open(segments), ["stable_key", "entry_key"], order)

    def compact(self) -> dict:
        """Fold all complete segments into a new snapshot, which names them; then they may go."""
        segments = self._segments()
        record = self.results.replace("log", self.key, lambda: {"states": self._last(segments)}, folded=segments)
        for s in segments:
            at, system = self.results._at(f"{self.tail}/{s}")
            system.delete(at, True)
        return record
