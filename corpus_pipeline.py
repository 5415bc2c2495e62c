"""The corpus pipeline: documents that pass every stage, packed into training sequences."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import gapfill  # noqa: E402
from gapfill.llm import decontam, line_dedup, near_dedup, packing, quality_model  # noqa: E402
from gapfill.llm.common import table  # noqa: E402
from gapfill.session import materialize, scratch_path  # noqa: E402

# Python workers need not have this folder on their path.
cloudpickle.register_pickle_by_value(gapfill)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, does not reject."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has in the same chunk; documents that lose all they had go."""
    return _sized(line_dedup.dedup(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def hierarchical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, in full sequences and balanced steps."""
    return packing.step_groups(materialize(packing.pack(docs), "packing"))


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), docs["n_chars"]))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", hierarchical_packing),
]

#: A classifier, sketches and a tokenizer are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
