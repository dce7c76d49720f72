"""From raw documents to token ids: quality, near-duplicates, benchmark passages, personal data, pieces.

Every stage is a function of (spark, docs, folder) to a DataFrame and works on
all that the stage before kept. All but the last return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import decontaminate, personal, pieces, quality, simhash
from fieldtally.llm.tables import table
from fieldtally.session import settle

# Trained rules, fingerprints in numbers, an automaton and a tokenizer are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    """The number of characters follows the text, where there are both."""
    if "n_chars" not in docs.columns:
        return docs
    counted = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return docs.withColumn("n_chars", counted)


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose quality score is high enough; the rules are learned from the documents and labels at hand."""
    model = quality.train(docs.select("doc_id", "text"), quality.usable_labels(table(spark, folder, "labels")))
    return quality.keep_good(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every near-duplicate group: the one with the least number."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not contaminated, without the passages they share with test items."""
    return _recount(decontaminate.decontaminate(docs, table(spark, folder, "benchmark")))


def personal_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _recount(personal.mask(docs))


def pieces_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of all documents."""
    return pieces.token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", simhash_stage),
    ("benchmark", benchmark_stage),
    ("personal", personal_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder, each stage's rows written and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
