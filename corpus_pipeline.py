"""The corpus pipeline: stages that each work on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import mixing, packing, quality, simhash, toxicity
from voxloom.llm.common import materialize


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go.

    Null and empty texts score the bias and stay; equal texts stay or go together; whole texts are read; an
    empty table gives an empty one; all columns are returned as they are, whatever their names.
    """
    return toxicity.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go.

    Null, empty and blank texts have too few words and go; equal texts stay or go together; whole texts are
    measured; an empty table gives an empty one; all columns are returned as they are, whatever their names.
    """
    return quality.filter_documents(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Null, empty and blank texts are one group; of repeated rows one stays; whole texts are compared; an empty
    table gives an empty one; all columns are returned as they are, whatever their names.
    """
    return simhash.deduplicate(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out so that sources meet their target weights.

    A null source is one of its own; null and empty texts have no size and are left out; rows that repeat are
    documents of their own; an empty table gives an empty one; columns are those of documents.
    """
    return mixing.mixed_documents(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids.

    Null and empty texts hold the end id alone; rows that repeat are packed as often as they occur; texts of any
    length are cut, none is shortened; an empty table gives no row; other columns are not read.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: Model scores, tokenizers and fingerprints are not SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else materialize(out, f"stage-{name}")
    return docs
