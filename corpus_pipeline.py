"""A training corpus in five stages: quality, near-duplicates, benchmark
leaks, secrets, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
its predecessor kept.  All but the last return the columns of ``documents``;
between stages the rows are written as Parquet and read again.  Null texts,
null or repeated keys, empty tables and further columns are handled as the
operators' docstrings say; no stage relies on ``doc_id`` being unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dqengine.llm.decontamination import without_leaks
from dqengine.llm.packing import pack
from dqengine.llm.quality import of_quality
from dqengine.llm.secrets import redacted
from dqengine.llm.simhash import one_of_each
from dqengine.session import materialize, stage_dir
from dqengine.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go."""
    return of_quality(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash neighbours (four-word shingles, four bits) the
    document with the smallest key stays."""
    return one_of_each(docs, shingle=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (five-word shingles, 0.8) go."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; no document goes."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences of 2048 tokens they share."""
    return pack(docs, capacity=2048)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

#: The classifier and SimHash cannot be put in SQL; tests compare ``run`` with
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"{stage_dir(spark)}/docs")
    return STAGES[-1][1](spark, docs, sf_dir)
