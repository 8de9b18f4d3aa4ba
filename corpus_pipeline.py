"""The corpus pipeline: documents through five operators, each stage written and read again by its caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quarrystone.llm import bagminhash, line_spread, packing, pii, quality_ordinal
from quarrystone.llm.common import importable, written

#: SQL cannot fit a classifier, draw signatures or pack bins; tests hold each stage against brute force.
ORACLE_SQL = None


def _with_lengths(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, n_chars counted anew where the text may have changed."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ordinal classifier rejects."""
    importable(spark)
    ratings = quality_ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_ordinal.classify(docs, ratings).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; every document stays."""
    return _with_lengths(line_spread.deduplicated(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id."""
    importable(spark)
    return bagminhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind, in brackets, in the place of personal data."""
    return _with_lengths(pii.redacted(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which training sequence."""
    import public_tokenizers as tokenizers

    importable(spark)
    return packing.pack(docs, tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents, a written table between each two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
