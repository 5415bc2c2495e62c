"""Tables over experiment results."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import duck_with, fixture, query
from checks.profile import RUN_MAPS_SQL, run_maps
from gapfill.functions.text import label_lookup
from gapfill.operators.results import (
    group_stats,
    imputer_means,
    metric_by_rate,
    metric_pairs,
    metric_quantiles,
    parse_run_name,
    pick_metrics,
    pivot_mean,
    run_summary,
    topk,
)

LABELS = {"view": "Page view", "click": "Click", "error": "Failure"}
IMPUTERS = ("click", "error", "purchase", "view")


def named_runs(spark, sf):
    """Run maps under dataset file names of two shapes, and some that do not parse."""
    maps = run_maps(spark, sf)
    name = F.expr(
        "case event_id % 4 when 0 then 'broken' when 1 then concat('train_text_imputed_', mechanism, '_simple_most_frequent_',"
        " missing_rate, '.parquet') else concat('train_text_imputed_', mechanism, '_', imputer, '_', missing_rate, '.parquet') end"
    )
    return maps.select("event_id", name.alias("dataset"), "metrics")


NAMED_SQL = f"""{RUN_MAPS_SQL}, named AS (SELECT event_id, has_metrics, eval_rmse, test_rmse,
    CASE event_id % 4 WHEN 0 THEN 'broken' WHEN 1 THEN 'train_text_imputed_' || mechanism || '_simple_most_frequent_'
      || missing_rate || '.parquet' ELSE 'train_text_imputed_' || mechanism || '_' || imputer || '_' || missing_rate || '.parquet' END AS dataset,
    CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE mechanism END AS mechanism,
    CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'simple_most_frequent' ELSE imputer END AS method,
    CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE missing_rate END AS ratio FROM run_maps),
  picked AS (SELECT event_id, dataset, mechanism, method, ratio, eval_rmse AS metric, test_rmse AS test_metric
    FROM named WHERE has_metrics)"""
_HEAD = f"{duck_with('runs')}, {NAMED_SQL}"


def picked(spark, sf):
    return pick_metrics(named_runs(spark, sf))


@query("parse_run_name", f"{_HEAD} SELECT event_id, mechanism, method, ratio FROM named")
def parse_run_name_of(spark, sf):
    return named_runs(spark, sf).select("event_id", parse_run_name("dataset").alias("n")).select("event_id", "n.*")


@query("pick_metrics", f"{_HEAD} SELECT * FROM picked")
def pick_metrics_of(spark, sf):
    return picked(spark, sf)


@query("run_summary", f"{_HEAD} SELECT * FROM picked ORDER BY mechanism, method, ratio")
def run_summary_of(spark, sf):
    return run_summary(picked(spark, sf))


def _pivot_sql(source: str, rows: str, cols: str, value: str, values) -> str:
    parts = ", ".join(f"round(avg({value}) FILTER (WHERE {cols} = '{v}'), 6) AS \"{v}\"" for v in values)
    return f"SELECT {rows}, {parts} FROM {source} GROUP BY {rows}"


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in df.columns if c not in keys])


@query("pivot_mechanism", f"{_HEAD} {_pivot_sql('picked', 'method', 'mechanism', 'metric', ('mar', 'mcar'))}")
def pivot_mechanism(spark, sf):
    return _rounded(pivot_mean(picked(spark, sf), "method", "mechanism", "metric", ("mar", "mcar")), "method")


@query("pivot_ratio", f"{_HEAD} {_pivot_sql('picked', 'method', 'ratio', 'metric', ('05', '15', '30'))}")
def pivot_ratio(spark, sf):
    return _rounded(pivot_mean(picked(spark, sf), "method", "ratio", "metric", ("05", "15", "30")), "method")


@query(
    "metric_stats",
    f"""{_HEAD} SELECT method, mechanism, ratio, round(avg(metric), 6) AS metric_mean, round(stddev_samp(metric), 6) AS metric_std,
        count(metric) AS metric_count FROM picked GROUP BY ALL""",
)
def metric_stats(spark, sf):
    found = group_stats(picked(spark, sf), ["method", "mechanism", "ratio"], ["metric"])
    return found.withColumns({c: F.round(c, 6) for c in ("metric_mean", "metric_std")})


@query(
    "label_imputers",
    f"""{duck_with('runs')} SELECT event_id, CASE imputer WHEN 'view' THEN 'Page view' WHEN 'click' THEN 'Click'
        WHEN 'error' THEN 'Failure' ELSE imputer END AS label FROM runs""",
)
def label_imputers(spark, sf):
    return fixture(spark, sf, "runs").select("event_id", label_lookup("imputer", LABELS).alias("label"))


@query("metric_by_rate", f"{duck_with('runs')} {_pivot_sql('runs', 'missing_rate', 'imputer', 'macro_f1', IMPUTERS)}")
def metric_by_rate_of(spark, sf):
    return _rounded(metric_by_rate(fixture(spark, sf, "runs"), "macro_f1", IMPUTERS), "missing_rate")


@query(
    "imputer_means",
    f"""{duck_with('runs')} SELECT imputer, round(avg(macro_f1), 6) AS macro_f1, round(avg(roc_auc), 6) AS roc_auc,
        round(avg(dp_diff), 6) AS dp_diff FROM runs GROUP BY imputer""",
)
def imputer_means_of(spark, sf):
    return _rounded(imputer_means(fixture(spark, sf, "runs")), "imputer")


@query("topk_metric", f"{duck_with('runs')} SELECT * FROM runs ORDER BY macro_f1 DESC NULLS LAST, event_id LIMIT 5")
def topk_metric(spark, sf):
    return topk(fixture(spark, sf, "runs"), "macro_f1", 5, "event_id")


@query("topk_abs", f"{duck_with('runs')} SELECT * FROM runs ORDER BY abs(dp_diff) NULLS LAST, event_id LIMIT 10")
def topk_abs(spark, sf):
    return topk(fixture(spark, sf, "runs"), "dp_diff", 10, "event_id", ascending=True, absolute=True)


def _ranked_sql(by: str, metric: str, k: int) -> str:
    return f"""{duck_with('runs')} SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {metric} DESC NULLS LAST, event_id) AS rank
        FROM runs QUALIFY rank <= {k}"""


@query("best_per_group", _ranked_sql("imputer", "macro_f1", 1))
def best_per_group(spark, sf):
    return topk(fixture(spark, sf, "runs"), "macro_f1", 1, "event_id", by=["imputer"])


@query("topk_per_group", _ranked_sql("mechanism", "roc_auc", 10))
def topk_per_group(spark, sf):
    return topk(fixture(spark, sf, "runs"), "roc_auc", 10, "event_id", by=["mechanism"])


@query(
    "group_summary",
    f"""{duck_with('runs')} SELECT imputer, {', '.join(
        f'round(avg({m}), 6) AS {m}_mean, round(median({m}), 6) AS {m}_median, round(stddev_samp({m}), 6) AS {m}_std'
        for m in ('macro_f1', 'roc_auc', 'dp_diff'))} FROM runs GROUP BY imputer""",
)
def group_summary(spark, sf):
    metrics = ["macro_f1", "roc_auc", "dp_diff"]
    return _rounded(group_stats(fixture(spark, sf, "runs"), ["imputer"], metrics, ("mean", "median", "std")), "imputer")


@query(
    "metric_pairs",
    f"{_HEAD} SELECT mechanism, method, ratio, metric, test_metric FROM picked WHERE test_metric IS NOT NULL",
)
def metric_pairs_of(spark, sf):
    return metric_pairs(picked(spark, sf))


@query(
    "metric_quantiles",
    f"""{duck_with('runs')} SELECT imputer, {', '.join(f'round(quantile_cont(macro_f1, {q}), 6) AS "{n}"' for q, n in (
        (0, 'min'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1, 'max')))} FROM runs GROUP BY imputer""",
)
def metric_quantiles_of(spark, sf):
    return _rounded(metric_quantiles(fixture(spark, sf, "runs"), ["imputer"], "macro_f1"), "imputer")
