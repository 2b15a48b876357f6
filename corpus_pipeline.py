"""Corpus pipeline: quality rules, near-duplicate removal, secret masking and packing, each on what the last one kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the columns of ``documents``. Null
texts hold no words, so the first stage drops them. Rows with a null id pass every stage. Rows that share an id count as
one document for the near-duplicate stage, which keeps or drops them together. Extra columns pass all stages but the
last. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import dedup, packing, quality, secrets
from skylattice.llm.common import drop_scratch, last_made, made, materialise, ship, table
from skylattice.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labeller keep."""
    return quality.keep_good(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more over five-word shingles."""
    ship(spark)
    return dedup.drop_near_duplicates(docs, k=5, percent=80)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by ``[SECRET]``."""
    ship(spark)
    return secrets.mask(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids placed in sequences of at most 2048."""
    ship(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_masking", secret_masking), ("best_fit_packing", best_fit_packing)]

#: Labelling, MinHash and tokenising are beyond SQL: the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``, a Parquet table between each two; what a stage made besides, and the
    table it read, are dropped when its own is written."""
    docs = table(spark, sf_dir, "documents")
    first = made()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, first, keep=[last_made()])
    return docs
