"""Tables over experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfill.functions.text import _col
from gapfill.operators.metrics import quantiles

METRICS = ("macro_f1", "roc_auc", "dp_diff")


def parse_run_name(col: Column | str) -> Column:
    """Struct ``(mechanism, method, ratio)`` of ``train_text_<version>_<mechanism>_<method...>_<ratio>``."""
    stem = F.regexp_replace(F.regexp_replace(_col(col), r"\.parquet$", ""), "^train_text_", "")
    p = F.split(stem, "_")
    ok = F.size(p) >= 4

    def part(value: Column) -> Column:
        return F.when(ok, value).otherwise(F.lit("unknown"))

    method = F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 3, F.lit(0))), "_")
    return F.struct(
        part(F.get(p, F.lit(1))).alias("mechanism"),
        part(method).alias("method"),
        part(F.element_at(p, -1)).alias("ratio"),
    )


def pick_metrics(df: DataFrame, metric: str = "eval_rmse", test_metric: str = "test_rmse", name: str = "dataset") -> DataFrame:
    """Runs with metrics as ``(…, mechanism, method, ratio, metric, test_metric)``."""
    m = F.col("metrics")
    picked = df.filter(m.isNotNull() & (F.size(m) > 0)).withColumn("_n", parse_run_name(name))
    return picked.select(
        *[_col(c) for c in df.columns if c != "metrics"],
        "_n.*",
        F.try_element_at(m, F.lit(metric)).alias("metric"),
        F.try_element_at(m, F.lit(test_metric)).alias("test_metric"),
    )


def run_summary(df: DataFrame) -> DataFrame:
    """Runs sorted by mechanism, method and ratio."""
    return df.orderBy("mechanism", "method", "ratio")


def pivot_mean(df: DataFrame, rows: str, cols: str, value: str, col_values: Sequence[str]) -> DataFrame:
    """Mean of ``value`` per row and column key; null keys are dropped."""
    keyed = df.filter(_col(rows).isNotNull() & _col(cols).isNotNull())
    return keyed.groupBy(rows).pivot(cols, list(col_values)).agg(F.avg(value))


_STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}


def group_stats(df: DataFrame, by: Sequence[str], values: Sequence[str], stats: Sequence[str] = ("mean", "std", "count")) -> DataFrame:
    """``<value>_<stat>`` columns per group; groups with null keys are dropped."""
    keyed = df
    for c in by:
        keyed = keyed.filter(_col(c).isNotNull())
    plain = [_STATS[s](v).alias(f"{v}_{s}") for v in values for s in stats if s != "median"]
    out = keyed.groupBy(*by).agg(*(plain or [F.count("*").alias("_n")])).drop("_n")
    if "median" in stats:
        for v in values:
            out = out.join(quantiles(keyed, by, v, {f"{v}_median": 0.5}), list(by), "left")
    return out.select(*by, *[f"{v}_{s}" for v in values for s in stats])


def metric_by_rate(df: DataFrame, metric: str, imputers: Sequence[str], rate: str = "missing_rate", imputer: str = "imputer") -> DataFrame:
    """Mean metric per missing rate, one column per imputer, sorted by rate."""
    return pivot_mean(df, rate, imputer, metric, imputers).orderBy(rate)


def imputer_means(df: DataFrame, metrics: Sequence[str] = METRICS, imputer: str = "imputer") -> DataFrame:
    """Mean of every metric per imputer."""
    return df.filter(_col(imputer).isNotNull()).groupBy(imputer).agg(*[F.avg(m).alias(m) for m in metrics])


def topk(
    df: DataFrame,
    metric: str,
    k: int = 5,
    tie: str = "experiment_id",
    ascending: bool = False,
    absolute: bool = False,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Best ``k`` rows by a metric, overall or per group; nulls last, ties by ``tie``."""
    value = F.abs(_col(metric)) if absolute else _col(metric)
    order = [value.asc_nulls_last() if ascending else value.desc_nulls_last(), _col(tie)]
    if by is None:
        return df.orderBy(*order).limit(k)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def metric_pairs(df: DataFrame, metric: str = "metric", test_metric: str = "test_metric") -> DataFrame:
    """Validation and test metric side by side, for runs that have a test metric."""
    return df.filter(_col(test_metric).isNotNull()).select("mechanism", "method", "ratio", metric, test_metric)


def metric_quantiles(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Minimum, quartiles and maximum per group (the numbers of a box plot)."""
    return quantiles(df, by, metric, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})
