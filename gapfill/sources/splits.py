"""Named splits: loading, exporting, previewing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfill.operators.profile import missing_summary

# The default split files.
DEFAULT_SPLITS = {"train": "train.parquet", "test": "test.parquet"}


def load_split(
    spark: SparkSession, root: str, split: str | None = None, mapping: Mapping[str, str] | None = None
) -> DataFrame | dict[str, DataFrame]:
    """One named split, or all of them when no name is given."""
    paths = dict(mapping or DEFAULT_SPLITS)
    if split is None:
        return {name: spark.read.parquet(f"{root}/{rel}") for name, rel in paths.items()}
    if split not in paths:
        raise KeyError(f"unknown split {split!r}; available: {sorted(paths)}")
    return spark.read.parquet(f"{root}/{paths[split]}")


def export_splits(
    splits: Mapping[str, DataFrame], out: str, format: str = "parquet", only: str | None = None
) -> DataFrame:
    """Write splits as Parquet or CSV; returns path, shape, columns and missing counts per split."""
    if format not in ("parquet", "csv"):
        raise ValueError("format must be 'parquet' or 'csv'")
    if only is not None and only not in splits:
        raise KeyError(f"unknown split {only!r}; available: {sorted(splits)}")
    info = None
    for name, df in splits.items():
        if only not in (None, name):
            continue
        path = f"{out}/{name}.{format}"
        writer = df.write.mode("overwrite")
        writer.parquet(path) if format == "parquet" else writer.csv(path, header=True)
        part = export_info(name, path, df)
        info = part if info is None else info.unionByName(part)
    return info


def export_info(name: str, path: str, df: DataFrame) -> DataFrame:
    """The info row set of one exported split, one row per column."""
    return missing_summary(df).select(
        F.lit(name).alias("split"),
        F.lit(path).alias("path"),
        (F.col("missing") + F.col("available")).alias("num_rows"),
        F.lit(len(df.columns)).cast("long").alias("num_cols"),
        "column",
        "missing_null",
        "missing_empty",
        "missing",
        "available",
    )


def preview(df: DataFrame, n: int = 10, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows; ordered by a key when one is given."""
    if n <= 0:
        raise ValueError("n must be positive")
    return (df.orderBy(order_by) if order_by else df).limit(n)
