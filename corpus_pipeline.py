"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but the last, which returns pieces of
packed sequences. Nulls, ties, repeated rows and very long texts are dealt with as the docstrings of the operators
that the stages call say; an empty table passes through all stages, and further columns of documents stay as they are.
What the stages wrote is read by the frame that `run` returns; `sieveline.llm.common.clear` takes it away.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import new_path, read_table
from sieveline.llm.mixing import mixture as mix_documents
from sieveline.llm.packing import Capacities, pack
from sieveline.llm.pii import mask_documents
from sieveline.llm.quality import keep_good
from sieveline.llm.queries import WISHED, vocabulary
from sieveline.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 and more."""
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return mask_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in the order of training."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, with no more documents and attention cost than wished where that costs no sequence."""
    return pack(docs, vocabulary(), Capacities(2048, 2048, 2048 * 2048), end_id=0, wished=WISHED, cache_parts=CACHE_PARTS)


#: Parts of texts whose ids a Python worker keeps: half of what the operator keeps alone, as workers hold what earlier stages left in them.
CACHE_PARTS = 400_000

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: Learned rules, fingerprints and tokenisation can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor wrote to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
