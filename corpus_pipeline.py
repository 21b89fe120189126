"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm import decontaminate, nbsvm, ngram_join, packing, secret_scan
from locusflow.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; it is fitted to the labelled ones among ``docs``.

    Null, empty and blank texts go, as there is nothing to accept; repeated rows stay or go together; a margin of 0 is
    no acceptance. Without labels every text with a word stays. No rows, no rows."""
    return nbsvm.quality_filter(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates.

    Rows with a null id or text, or without a word, stay; so do rows repeated under an id that stays. No rows, no rows."""
    return ngram_join.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged one by one: null and empty texts stay, repeated rows stay or go together. Without items all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; null and empty texts and repeated rows stay as they are."""
    return secret_scan.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to ``packing.CAPACITY`` tokens, one a row, with the text that the stages before left.

    Texts without a token are in none; repeated rows are packed each for itself. No rows, no sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", dedup),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", redacted),
    ("best_fit_packing", packed),
]

#: A fitted classifier can't be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
