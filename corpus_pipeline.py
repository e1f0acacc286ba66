"""Corpus pipeline: from documents to shuffled shards of a clean, mixed corpus.

Each stage takes all rows that the one before it kept and returns the columns
of documents, whatever they are called; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from millrace.llm.storage import stored

SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found.

    Null and empty texts and texts without letters go; repeated rows each stay; an empty table gives no rows.
    """
    return language_id.in_a_language(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least id.

    Texts without words all stay; a null id loses to any other; of rows equal in id and text one stays.
    """
    return jaccard_join.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % stands in the benchmark.

    Benchmark items that are null or empty never match; with an empty benchmark all stay.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for: at least once, so none is lost.

    Null sources form one source; texts without words are drawn with every whole block of their source.
    """
    return mixing.mixed(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in seeded random order, dealt to shards: shard and slot are added, in place of columns of these names.

    Repeated rows all stay, in different slots; an empty table gives no rows.
    """
    return sharding.shuffle_into_shards(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", write_shards),
]

# Similarity classes and byte-trigram models have no SQL form of use; the tests hold the
# pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole documents table, each written to shared storage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
