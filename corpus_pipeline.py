"""A corpus pipeline of five stages over ``documents``; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the columns of ``documents``; other columns of its input are left out.

Cases, for all stages: a null text is an empty one and a null in any other column stays as it is; empty tables give empty
tables; very long texts are taken whole. Empty texts and null ids: toxicity scores them by its offset; near_dedup keeps one
document of each class, that of the least id (nulls last); decontamination keeps them; mixing takes no copy of a text
without words; token_ids gives each its end id. Rows repeated with id and text: toxicity and decontamination treat all
alike, near_dedup keeps one, mixing gives each its own copies, token_ids writes all, ordered by the text's hash. Ties: see
the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import binary, decontamination, mixing, neardup, store, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of all documents but the held-out ones; documents that score 0.5 or more go. Without labels of both
    classes nothing can be told, and nothing goes unless all labels are toxic."""
    docs = docs.select(*COLUMNS)
    labels = store.read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model, "toxicity_score").where("toxicity_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id stays of each class of near-duplicates."""
    return neardup.kept(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    return decontamination.clean(docs.select(*COLUMNS), store.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(docs.select(*COLUMNS))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as files of token ids; what is read back from them."""
    folder = store.new_path(spark, "pipeline-tokens")
    binary.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return binary.read_ids(spark, folder, checksum=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: SQL has no Kneser-Ney, MinHash, WAND or tokenizer; the tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again for the next; tables that no later stage reads go."""
    docs = store.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        store.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
