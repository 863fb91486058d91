"""A corpus pipeline of five stages; each works on all that the stage before kept.

Columns beside doc_id, text and source pass through untouched, whatever their names; helper
columns get names that the table does not have.  An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtally.llm import mix, pack, quality_forest, quality_gam, simhash
from flowtally.llm.common import discard, store, vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep.

    Null and empty texts go (fewer than 50 words), very long ones are judged whole, repeated
    rows are judged alike; without labels only the base rules decide.
    """
    return quality_forest.kept_rows(docs, _labels(spark, sf_dir))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.3 or more.

    Null texts are scored as empty ones, repeated rows alike; ties at 0.3 stay; without
    labels every score is 0.5, so all stay.
    """
    return quality_gam.good_rows(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates.

    The smallest doc_id stays, a null one only where its group has no other; of repeated rows
    one stays; null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it (never to twice).

    A null source is a source of its own; documents without words are not taken; repeated
    rows take places of their own; equal quotients go to the first source, then shard.
    """
    return mix.mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens.

    A null or empty text is its end id alone, a very long one many full windows; repeated
    rows are packed each.
    """
    return pack.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

# Model fitting, tokens and hashes have no SQL form; tests/llm/test_brute_force.py holds every stage against a plain account.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
