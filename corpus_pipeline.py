"""Training corpus from raw documents, in stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.bindings.registry import Registered
from trackweave.llm import exact_dedup, packing, quality_rules, simhash, substring_dedup
from trackweave.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# What the stages read; other columns come along whatever they are called.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def with_any_columns(stage: Stage) -> Stage:
    """The stage with further columns under plain names while it works, so that none clashes with a column of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [name if name in DOCUMENT else f"column_{i}" for i, name in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*own), sf_dir).toDF(*docs.columns)

    return run


@with_any_columns
def unrepetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go: null, empty and short ones too. Repeated rows are judged alike."""
    return quality_rules.judged(docs).filter("kept").select(*docs.columns)


@with_any_columns
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null texts are empty ones, null and repeated ids as in ``exact_dedup``."""
    return exact_dedup.keep_one(docs)


@with_any_columns
def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by their fingerprints the one with the smallest doc_id stays; null and repeated ids as in ``keep_first``."""
    return simhash.keep_first(docs)


@with_any_columns
def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that several documents hold stay in one of them; the others lose them, not their row. Null texts stay null."""
    cut = substring_dedup.without_repeated_passages(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the padded batches; null and empty texts take no room, repeated rows have a place each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", unrepetitive),
    ("exact_dedup", distinct_texts),
    ("near_dedup", no_near_duplicates),
    ("substring_dedup", no_repeated_passages),
    ("packing", packed),
]

# Suffix arrays, Hamming distances and rolling hashes are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTERED = Registered(run, ORACLE_SQL)
