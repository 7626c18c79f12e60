"""The queries of this subpackage for the driver: (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, counts, decontamination, katz, linedup, media, mixing, neardup, phrases, store, substrings, toxicity, urls, whitening

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a page is the quality of the document of the same id."""
    labels = store.read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return urls.judged(store.read_table(spark, sf_dir, "pages"), labels)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_path(spark, "token-ids")
    binary.write_ids(store.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return binary.read_ids(spark, folder, checksum=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = store.read_table(spark, sf_dir, "documents"), store.read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.scored(docs.select("doc_id", "text"), model).withColumn("held_out", toxicity.held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(store.read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.saved(mixing.measured(store.read_table(spark, sf_dir, "documents")), "sizes")
    mix = mixing.mixed(rows)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.judged(store.read_table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store.saved(media.stored(store.read_table(spark, sf_dir, "documents")), "media")
    return media.digests(media.sniffed(files))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.count_tokens(store.read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > counts.LIMIT).alias("over_limit"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = katz.fit(docs.where(katz.trained_on()))
    scored = katz.scored(docs, model).withColumns({"held_out": katz.held_out(), "train_tokens": F.lit(model.train_tokens).cast("long")})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(store.read_table(spark, sf_dir, "documents"), store.read_table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    n, explained, error = (model.n, model.explained, model.identity_error) if model else (0, [], 0.0)
    each = whitening.whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained]).cast("array<double>")
    return each.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(store.read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(store.read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_ids": op2_token_ids,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_media": op7_media,
    "op8_token_counts": op8_token_counts,
    "op9_lm_score": op9_lm_score,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op1_url_filters": urls.ORACLE, "op5_mixing": mixing.ORACLE, "op13_collocations": phrases.ORACLE}
