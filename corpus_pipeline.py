"""Corpus pipeline: documents to token files in five stages.

Every stage reads what its predecessor kept, written as Parquet in the shared folder, so a lost
executor costs no more than the tasks it was running. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pluvia.llm import decontaminate, language_id, mixing, simhash, token_files
from pluvia.llm.common import stored, table

#: The mixture holds this many percent of the tokens that reach it, no document twice.
MIXED_PERCENT = 90


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model accepts: no letter, or far from every language."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts domains, languages and sources down towards their target weights."""
    return mixing.select_documents(docs, budget_percent=MIXED_PERCENT)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns place, length and check sum of every document."""
    return token_files.token_digest(docs, token_files.default_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Language models and fingerprints are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
