"""Corpus preparation: toxicity filter, near-duplicate removal, mixing to target weights, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm.common import materialise, table
from statera.llm.mixture import mixed
from statera.llm.packing import pack
from statera.llm.shingle_copies import without_near_copies
from statera.llm.toxicity import without_toxic

#: Not SQL: the first stage fits a classifier, the last packs step by step.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Nulls, empty and long texts, repeats, an empty table and other columns: see :func:`without_toxic`.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share 0.8 or more of their five-word shingles with an earlier one go.

    Nulls, empty and long texts, ties, repeats, an empty table and other columns: see :func:`without_near_copies`.
    """
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights; a document comes as often as the mix takes it.

    Documents without words (null, empty) are taken at their source's rate and add no words; null sources are one source, null ids come
    first in their class, repeated rows count each. An empty table gives no rows; other columns stay: see :func:`mixed`.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in training sequences; copies of a document are one duplicate cluster, so they never share a sequence.

    Null and empty texts take a place of size 0, long texts are cut into full sequences and a rest, rows with a null id conflict with
    none but those of their source. An empty table gives no rows; other columns are left: see :func:`pack`.
    """
    return pack(docs, F.col("doc_id"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicate_removal), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
