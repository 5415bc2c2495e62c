"""Missingness profiles. Every profile is one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfill.functions.scores import at_least
from gapfill.functions.text import _col, is_null_like


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count("*").alias("num_rows"), F.lit(len(df.columns)).cast("long").alias("num_cols"))


def _null_count(field: T.StructField) -> Column:
    return F.count_if(is_null_like(field.name, field.dataType))


def _empty_count(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.count_if(_col(field.name) == "")
    return F.lit(0).cast("long")


def missing_summary(df: DataFrame) -> DataFrame:
    """Null, empty, missing and available rows of every column (``null_or_empty`` rule)."""
    aggs = [F.count("*").alias("_n")]
    for i, field in enumerate(df.schema):
        aggs += [_null_count(field).alias(f"_null{i}"), _empty_count(field).alias(f"_empty{i}")]
    rows = [
        F.struct(
            F.lit(field.name).alias("column"),
            F.col(f"_null{i}").alias("missing_null"),
            F.col(f"_empty{i}").alias("missing_empty"),
        )
        for i, field in enumerate(df.schema)
    ]
    return (
        df.agg(*aggs)
        .select("_n", F.explode(F.array(*rows)).alias("r"))
        .select("_n", "r.*")
        .withColumn("missing", F.col("missing_null") + F.col("missing_empty"))
        .withColumn("available", F.greatest(F.col("_n") - F.col("missing"), F.lit(0).cast("long")))
        .drop("_n")
    )


def summarize_column(df: DataFrame, column: str) -> DataFrame:
    """Null and empty-string count of one column."""
    if column not in df.columns:
        raise KeyError(f"no column {column!r}")
    field = df.schema[column]
    return df.agg(_null_count(field).alias("null"), _empty_count(field).alias("empty_string"))


def missing_profile(tagged: Mapping[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Profile of the tagged union of several tables, most missing column first."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tagged.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    summary = missing_summary(union)
    total = F.col("missing_total") + F.col("available")
    return (
        summary.withColumnRenamed("missing", "missing_total")
        .withColumn("missing_ratio", F.when(total > 0, F.col("missing_total") / total))
        .orderBy(F.desc("missing_total"), "column")
    )


def version_stats(
    df: DataFrame, by: Sequence[str], text: str = "text", extra: str | None = "framing", mask: str = "text_is_missing"
) -> DataFrame:
    """Shape, actual missing rate and null/empty counts of every injected version at once."""
    aggs = [
        F.count("*").alias("num_rows"),
        F.lit(len([c for c in df.columns if c not in by])).cast("long").alias("num_cols"),
        F.avg(_col(mask).cast("double")).alias("actual_rate"),
    ]
    for c in (text, extra):
        if c and c in df.columns:
            field = df.schema[c]
            aggs += [_null_count(field).alias(f"{c}_null"), _empty_count(field).alias(f"{c}_empty")]
    return df.groupBy(*by).agg(*aggs)


def inspect_mechanism(
    df: DataFrame,
    by: Sequence[str],
    thresholds: Mapping[str, float],
    groups: Sequence[str] = (),
    author: str | None = None,
    group_col: str = "target_group",
    author_col: str = "predicted_author",
    mask: str = "text_is_missing",
) -> DataFrame:
    """How much more often does a trigger occur among missing rows than among all rows?"""
    missing = F.coalesce(_col(mask), F.lit(False))

    def share(hit: Column, name: str) -> list[Column]:
        one = hit.cast("double")
        return [
            F.avg(one).alias(f"{name}_ratio"),
            F.coalesce(F.avg(F.when(missing, one)), F.lit(0.0)).alias(f"{name}_missing_ratio"),
        ]

    aggs = [
        F.count("*").alias("total"),
        F.count_if(missing).alias("missing_count"),
        F.avg(missing.cast("double")).alias("missing_rate"),
    ]
    for column, threshold in thresholds.items():
        if column in df.columns:
            aggs += share(at_least(column, threshold), f"{column}_high")
    if groups and group_col in df.columns:
        aggs += share(F.coalesce(_col(group_col).isin(*groups), F.lit(False)), "group_focus")
    if author is not None and author_col in df.columns:
        aggs += share(F.coalesce(_col(author_col) == author, F.lit(False)), "author_focus")
    return df.groupBy(*by).agg(*aggs)
