"""Results that appear as one, and a status log with compaction."""

import pytest
from pyspark.sql import functions as F

from codeloom.plans import diff
from codeloom.publication import Refused, Results, StatusLog, Unpublished


def test_a_result_appears_with_its_record(spark, tmp_path):
    results, key = Results(spark, str(tmp_path)), {"repository_id": 1, "diff_id": 7}
    made = lambda n: lambda: {"a": spark.range(n), "b": spark.range(2 * n)}
    with pytest.raises(Unpublished):
        results.read("diffs", key, "a")
    results.replace("diffs", key, made(3))

    def dies():
        results._write("diffs", key, {"a": spark.range(9)})  # tables are there, the record never comes
        raise RuntimeError

    with pytest.raises(RuntimeError):
        results.replace("diffs", key, dies)
    assert (results.read("diffs", key, "a").count(), results.read("diffs", key, "b").count()) == (3, 6)
    # a record that was cut while it was written is no record
    results._create(f"{results.folder('diffs', key)}/records/0000000002.json", '{"version": "x"')
    assert results.read("diffs", key, "a").count() == 3
    results.replace("diffs", key, made(4))
    assert results.current("diffs", key)["number"] == 3 and results.read("diffs", key, "b").count() == 8
    assert len(results.vacuum("diffs", key)) == 2 and results.read("diffs", key, "a").count() == 4
    assert [(r["repository_id"], r["diff_id"], r["number"]) for r in results.keys("diffs", 2).collect()] == [(1, 7, 3)]


def test_two_writers_of_one_result_converge(spark, tmp_path):
    results, key = Results(spark, str(tmp_path)), {"repository_id": 1, "diff_id": 7, "depth": 2}

    def late():
        results.ensure("impact", key, lambda: {"nodes": spark.range(5)})  # the other one publishes meanwhile
        return {"nodes": spark.range(6)}

    record = results.ensure("impact", key, late)
    assert results.read("impact", key, "nodes").count() == 5 and record["version"] == results.current("impact", key)["version"]
    assert results._names(f"{results.folder('impact', key)}/data") == [record["version"]]
    never = lambda: pytest.fail("computed again")
    assert results.ensure("impact", key, never)["version"] == record["version"]
    results.ensure("impact", key | {"depth": 3}, lambda: {"nodes": spark.range(8)})
    assert [results.read("impact", key | {"depth": d}, "nodes").count() for d in (2, 3)] == [5, 8]


def test_identity_of_diffs():
    assert diff.identity(1, "abc", "def") == diff.identity(1, " abc ", "def") != diff.identity(1, "def", "abc") != diff.identity(2, "def", "abc")
    for ends in (("abc", "abc"), ("abc", "abc ")):
        with pytest.raises(diff.SameRevision):
            diff.identity(1, *ends)
    with pytest.raises(ValueError):
        diff.identity(1, "", "abc")


def test_status_log(spark, tmp_path):
    log = StatusLog(Results(spark, str(tmp_path)), {"repository_id": 1, "diff_id": 7}, ["OPEN", "DONE", "SKIPPED"], ["OPEN", "DONE"], 10)
    known = spark.createDataFrame([("k1", None), ("k2", None), ("k1", "e1"), ("k2", "e1")], "stable_key string, entry_key string")
    put = lambda *rows: log.append(spark.createDataFrame(rows, "stable_key string, entry_key string, status string, notes string"), known)
    state = lambda: {(r["stable_key"], r["entry_key"]): (r["status"], r["notes"]) for r in log.latest().collect()}
    assert state() == {}
    assert put(("k1", None, "DONE", "x" * 30), ("k1", "e1", "DONE", "")) == 2
    for bad in (("k3", None, "DONE", ""), ("k1", "e9", "DONE", ""), ("k1", None, "LATER", ""), ("k1", "e1", "SKIPPED", ""), ("k1", None, None, "")):
        with pytest.raises(Refused):
            put(("k2", None, "DONE", ""), bad)
    want = {("k1", None): ("DONE", "x" * 10), ("k1", "e1"): ("DONE", "")}
    assert state() == want  # nothing of a refused batch is there
    put(("k1", None, "SKIPPED", "later"))
    put(("k2", "e1", "DONE", None))
    want |= {("k1", None): ("SKIPPED", "later"), ("k2", "e1"): ("DONE", None)}
    assert state() == want
    assert len(log.compact()["folded"]) == 3 and state() == want
    put(("k1", None, "OPEN", ""))
    assert state() == want | {("k1", None): ("OPEN", "")}
    record = log.compact()
    assert len(record["folded"]) == 1 and state() == want | {("k1", None): ("OPEN", "")}
    # a segment that a snapshot holds counts once, though it may still be there; one that is not complete doesn't count
    spark.createDataFrame([("k1", None, "DONE", "", None)], "stable_key string, entry_key string, status string, notes string, updated_at timestamp").withColumn("updated_at", F.current_timestamp()).write.parquet(f"{log.tail}/{record['folded'][0]}")
    spark.range(1).write.parquet(f"{log.tail}/0badbad")
    (tmp_path / "log/repository_id=1/diff_id=7/tail/0badbad/_SUCCESS").unlink()
    assert state() == want | {("k1", None): ("OPEN", "")}
