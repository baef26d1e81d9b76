"""The corpus pipeline: documents through five operators, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import packing, passages, pii, quality, simhash
from tidewake.llm.shared import documents, drop, recorded, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond their group's fences go."""
    return quality.stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    return simhash.stage(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has too are cut out."""
    return passages.stage(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces packed into sequences."""
    return packing.op4_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Quantile sketches, components, chaining and packing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of what the stages leave of documents. Tables that later stages don't read are deleted as they go."""
    docs, held = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir))
        drop(spark, held + made[:-1])
        held = made[-1:]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop(spark, held)  # the pieces are a table by now
    return packed
