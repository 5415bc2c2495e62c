"""Synthetic missingness: nested MCAR and MAR masks and injected versions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.functions.scores import at_least, uniform, weighted_order_key
from gapfill.functions.text import _col, rate_tag_of
from gapfill.operators.select import smallest_k_cuts, within_cut

# Default rates, seed and weights.
RATES = (0.05, 0.15, 0.30)
SEED = 42
BASE_WEIGHT = 1.0
HIGH_VALUE_BOOST = 3.0
GROUP_BOOST = 2.0
AUTHOR_BOOST = 1.5
MIN_WEIGHT = 1e-6


def empty_to_null(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Turn empty strings into nulls; columns the table lacks are skipped."""
    names = [cols] if isinstance(cols, str) else list(cols)
    present = {c: F.nullif(_col(c), F.lit("")) for c in names if c in df.columns}
    return df.withColumns(present) if present else df


def check_rates(rates: Sequence[float]) -> list[float]:
    if any(not 0 <= r <= 1 for r in rates):
        raise ValueError("missing rates must lie in [0, 1]")
    return sorted(dict.fromkeys(rates))


def mcar_size(rate: float, n: int) -> int:
    """``floor(rate * n)``, at least one row for a positive rate."""
    k = math.floor(rate * n)
    return 1 if rate > 0 and k == 0 and n > 0 else k


def mar_size(rate: float, n: int) -> int:
    """``rate * n`` rounded half to even, within [0, n]."""
    return max(0, min(round(rate * n), n))


def _masks(df: DataFrame, order: Column, key: str, rates: Sequence[float], size) -> dict[float, Column]:
    rates = check_rates(rates)
    cuts, counts = smallest_k_cuts(df, order, key, lambda c: {0: [size(r, c.get(0, 0)) for r in rates]})
    n = counts.get(0, 0)
    return {r: within_cut(order, key, cuts[(0, size(r, n))]) for r in rates}


def mcar_mask_columns(
    df: DataFrame, key: str, rates: Sequence[float] = RATES, seed: int = SEED, order: Column | None = None
) -> dict[float, Column]:
    """Boolean mask expression per rate, all cut from one random order, so the masks nest.

    ``order`` names a column of ``df`` that holds the order key already.
    """
    return _masks(df, uniform(key, seed) if order is None else order, key, rates, mcar_size)


def mar_weight(
    df: DataFrame,
    thresholds: Mapping[str, float] | None = None,
    groups: Sequence[str] = (),
    authors: Sequence[str] = (),
    group_col: str = "target_group",
    author_col: str = "predicted_author",
    base: float = BASE_WEIGHT,
    high_value_boost: float = HIGH_VALUE_BOOST,
    group_boost: float = GROUP_BOOST,
    author_boost: float = AUTHOR_BOOST,
) -> Column:
    """Row weight: base plus a boost for every trigger that holds; absent columns are skipped."""
    weight = F.lit(float(base))
    for column, threshold in (thresholds or {}).items():
        if column in df.columns:
            weight = weight + F.when(at_least(column, threshold), F.lit(float(high_value_boost))).otherwise(F.lit(0.0))
    for column, values, boost in ((group_col, groups, group_boost), (author_col, authors, author_boost)):
        if values and column in df.columns:
            hit = F.coalesce(_col(column).isin(*values), F.lit(False))
            weight = weight + F.when(hit, F.lit(float(boost))).otherwise(F.lit(0.0))
    return F.greatest(weight, F.lit(MIN_WEIGHT))


def mar_weights(df: DataFrame, out: str = "weight", **weights) -> DataFrame:
    """``df`` with the sampling weight of every row."""
    return df.withColumn(out, mar_weight(df, **weights))


def mar_order(df: DataFrame, key: str, seed: int = SEED, **weights) -> Column:
    """Order key of sampling rows in proportion to their weight."""
    return weighted_order_key(key, mar_weight(df, **weights), seed)


def mar_mask_columns(
    df: DataFrame, key: str, rates: Sequence[float] = RATES, seed: int = SEED, order: Column | None = None, **weights
) -> dict[float, Column]:
    """Like :func:`mcar_mask_columns`, with rows drawn in proportion to their weight."""
    return _masks(df, mar_order(df, key, seed, **weights) if order is None else order, key, rates, mar_size)


def weighted_sample(df: DataFrame, key: str, k: int, seed: int = SEED, **weights) -> DataFrame:
    """``k`` rows drawn without replacement in proportion to their weight."""
    order = weighted_order_key(key, mar_weight(df, **weights), seed)
    cuts, _ = smallest_k_cuts(df, order, key, lambda c: {0: [k]})
    return df.filter(within_cut(order, key, cuts[(0, k)]))


def _with_masks(df: DataFrame, masks: Mapping[float, Column]) -> DataFrame:
    return df.withColumns({f"missing_{rate_tag_of(r)}": m for r, m in masks.items()}).drop("_order")


def mcar_masks(df: DataFrame, key: str, rates: Sequence[float] = RATES, seed: int = SEED) -> DataFrame:
    """``df`` with one mask column ``missing_<tag>`` per rate."""
    ordered = df.withColumn("_order", uniform(key, seed))
    return _with_masks(ordered, mcar_mask_columns(ordered, key, rates, seed, F.col("_order")))


def mar_masks(df: DataFrame, key: str, rates: Sequence[float] = RATES, seed: int = SEED, **weights) -> DataFrame:
    """``df`` with one weighted mask column ``missing_<tag>`` per rate."""
    ordered = df.withColumn("_order", mar_order(df, key, seed, **weights))
    return _with_masks(ordered, mar_mask_columns(ordered, key, rates, seed, F.col("_order")))


def apply_mask(df: DataFrame, mask: Column, rate: float | Column, text: str = "text") -> DataFrame:
    """Blank the text where ``mask`` holds and record original text, mask and rate."""
    if text not in df.columns:
        raise KeyError(f"no column {text!r} to inject missing values into")
    rate_col = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    return (
        df.withColumn("text_original", _col(text))
        .withColumn("text_is_missing", F.coalesce(mask, F.lit(False)))
        .withColumn("text_missing_rate", F.when(F.col("text_is_missing"), rate_col).otherwise(F.lit(0.0)))
        .withColumn(text, F.when(F.col("text_is_missing"), F.lit(None).cast("string")).otherwise(_col(text)))
    )
