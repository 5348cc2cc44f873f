"""A training corpus from raw documents: stages that each read what the one before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the runner writes it as Parquet and gives the reread table to
the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cytoloom.llm import decontam, language, mixing, ngram_join, sharding
from cytoloom.llm.tables import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and those in none of the languages that the corpus labels."""
    return language.recognised(docs, language.learn(docs)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8; the smallest doc_id stays."""
    return ngram_join.one_of_each_group(docs, n=5, percent=80).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat ten consecutive words of a benchmark item."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    return mixing.mix(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and the shard (0 to 7) of each row, in contiguous ranges of nearly equal bytes."""
    return sharding.with_shard(docs, 8)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language ID is a trained model, which SQL cannot express; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
