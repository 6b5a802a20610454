"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes all rows its predecessor kept. ``run`` writes every stage as
Parquet in the shared scratch folder and rereads it for the next one, so a
lost executor never costs more than the stage at work.

Every stage takes any table with the columns of documents and more: further
columns are carried to the stage before packing, whatever their names; null
ids and sources, null, empty and very long texts and repeated rows have the
results stated per stage; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.llm import mixing, packing, pii, quality_rules, simhash
from ticksmith.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the repetition limits keep.

    Null and blank texts have no words and go; repeated rows are judged alike.
    """
    return quality_rules.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest id.

    Rows without an id stay only where their group has no other; repeated rows
    and all texts without words are one group each.
    """
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; ``n_chars`` follows the new text.

    All rows stay; a null text stays null, and so does its ``n_chars``.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights, in shuffled order.

    Rows without a source are a source of their own; rows without an id draw by
    their text; repeated rows draw alike. A document drawn zero times goes.
    """
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place.

    A null text is empty and has its end token alone. Copies of a document
    have the same id and pieces; ``sequence_id`` and ``offset`` tell them apart.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Suffix arrays, XXH64 and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
