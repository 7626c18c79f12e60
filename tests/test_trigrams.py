"""Substring search by an index: the rows of a scan, from few files."""

import pytest
from pyspark.sql import functions as F

from codeloom.plans import search, trigrams

WORDS = ["alpha", "Beta_x", "beta%y", "a_b", "İstanbul", "straße", "漢字漢字", "😀ab", "a\\b", "ΣΑΣ", "x", "", "aaaa"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [(k, f"src/{WORDS[k % 13]}/{k}.py", "\n".join(WORDS[(k * j) % 13] + str(k % 7) for j in range(1, 6)), 10, WORDS[k % 13], f"m.{WORDS[(k * 5) % 13]}", "CLASS") for k in range(300)]
    df = spark.createDataFrame([*rows, (999, "null.py", None, 0, "n", "n", "CLASS")], "file_id long, path string, content string, size_bytes int, name string, qualified_name string, kind string")
    files, symbols = df.select("file_id", "path", "content", "size_bytes"), df.select(F.col("file_id").alias("symbol_id"), "file_id", "name", "qualified_name", "kind")
    folders = [str(tmp_path_factory.mktemp("index")) for _ in range(2)]
    search.index_files(files, folders[0])
    search.index_symbols(symbols, folders[1])
    return files, symbols, folders


@pytest.mark.parametrize("query", ["BETA", "a_b", "ta%y0", "İSTAN", "straße", "字漢字", "😀ab", "a\\b", "σας", "aaaaa"])
def test_same_rows_as_a_scan(spark, indexed, query):
    files, symbols, (text_index, symbol_index) = indexed
    rows = lambda df: [tuple(r) for r in df.collect()]
    for sensitive in (False, True)[: 1 + (query < "b")]:
        assert rows(search.search_text_by(spark, text_index, query, case_sensitive=sensitive, limit=5000)) == rows(search.search_text(files, query, case_sensitive=sensitive, limit=5000))
    assert rows(search.search_symbols_by(spark, symbol_index, files, query, limit=5000)) == rows(search.search_symbols(symbols, files, query, limit=5000))
    assert rows(search.search_files_by(spark, text_index, symbols, query, limit=5000)) == rows(search.search_files(files, symbols, query, limit=5000))


def test_few_files_are_read(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("file_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("common text "), F.when(F.col("id") == 7, "needle").otherwise(F.col("id").cast("string"))).alias("content"))
    search.index_files(rows, str(tmp_path))
    found = trigrams.narrowed(spark, str(tmp_path), "file_id", "needle")
    assert [r["file_id"] for r in found.collect()] == [7]
    assert len(found.inputFiles()) > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1]
    grams = trigrams.query_grams(spark, "needle")
    assert sorted(grams) == ["dle", "edl", "eed", "nee"] and trigrams.query_grams(spark, "n_e%dl") == []
    postings = spark.read.parquet(f"{tmp_path}/postings").where(F.col("gram").isin(grams))
    assert postings.count() == 4
