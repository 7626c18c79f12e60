"""Substring search by an index of trigrams, for ``contains`` and ``ILIKE`` alike.

The index has a row (bucket, gram, id) for each three characters in a row that a text of a row has, its case folded, in files by bucket (a
hash of the gram) and sorted by gram, so a lookup opens the buckets of its grams only and of these only the row groups that can hold
them. A bucket is dealt to several tasks and files by the rows' ids, and with it a gram that every text has. Next to it the
texts are stored by part (a hash of the id): candidates, the rows that have all grams of a query, name the parts that are read, and only
their texts are compared with the query, by the condition that a scan would use.

``%`` and ``_`` of a query stand for any characters in ``ILIKE``; grams come from the pieces between them. A query without three
characters in a row has no grams, and is searched by a scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folding import casefold
from ..operators.lineage import saved

BUCKETS = PARTS = 64
SALTS = 8  # tasks and files of a bucket
FEW = 100_000  # candidates that are broadcast; more are joined by shuffle


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text whose case is folded."""
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit("(?s)(?=(.{3}))"), 1))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _part(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(PARTS)).cast("int")


def build(rows: DataFrame, id_: str, texts: list[str], folder: str) -> None:
    """Write ``rows`` and the index of their columns ``texts`` to ``folder``; the index is made from the rows as they are stored, part by
    part."""
    rows.withColumn("_part", _part(F.col(id_))).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{folder}/rows")
    stored = rows.sparkSession.read.parquet(f"{folder}/rows")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.col(c).alias("text")) for k, c in enumerate(texts)]))
    postings = stored.select(F.col(id_).alias("id"), each.alias("t")).select("id", "t.of", F.explode(grams(F.col("t.text"))).alias("gram"))
    postings = postings.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    postings.sortWithinPartitions("bucket", "gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def query_grams(spark: SparkSession, query: str, wildcards: bool = True) -> list[str]:
    """The grams that every text has that holds the query; none if it may hold less than three characters in a row."""
    pieces = re.split("[%_]", query) if wildcards else [query]
    row = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[grams(F.lit(p)) for p in pieces]))).alias("g"))
    return row.collect()[0]["g"]


def candidates(spark: SparkSession, folder: str, wanted: list[str]) -> DataFrame:
    """id of the rows that have all wanted grams in one of the indexed columns."""
    buckets = [r["b"] for r in spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in wanted])).alias("g")).select(_bucket(F.col("g")).alias("b")).distinct().collect()]  # a row a gram of the query
    found = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    return found.groupBy("id", "of").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select("id").distinct()


def narrowed(spark: SparkSession, folder: str, id_: str, query: str, wildcards: bool = True) -> DataFrame:
    """The stored rows that may match: all, or the candidates read from their parts."""
    stored = spark.read.parquet(f"{folder}/rows")
    wanted = query_grams(spark, query, wildcards)
    if not wanted:
        return stored.drop("_part")
    found = saved(candidates(spark, folder, wanted))
    parts = [r["p"] for r in found.select(_part(F.col("id")).alias("p")).distinct().collect()]  # PARTS at most
    few = found.limit(FEW + 1).count() <= FEW
    ids = found.withColumnRenamed("id", id_)
    return stored.where(F.col("_part").isin(parts)).drop("_part").join(F.broadcast(ids) if few else ids, id_, "left_semi")
