"""The corpus pipeline: classify, remove exact and near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``. No stage is SQL: exact
dedup, near dedup and packing are held against brute-force versions in tests/llm, mixing against operator 3's
counts, the classifier against labels only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimforge.llm.common import few_texts, table
from claimforge.llm.cuckoo import exact_dedup
from claimforge.llm.jaccard import keep_one_of_group
from claimforge.llm.mixing import mixed_documents
from claimforge.llm.packing import pack
from claimforge.llm.quality import fit, keep_good
from claimforge.operators.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier, fitted on these documents, holds for good."""
    few_texts(spark)
    return keep_good(docs, fit(docs)).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one_of_group(docs, k=5, percent=80).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' weights takes it."""
    return mixed_documents(docs).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_jaccard", near), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each hands on is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
