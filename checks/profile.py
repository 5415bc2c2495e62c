"""Sources and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import duck_with, fixture, query, table
from gapfill.functions.text import rate_tag  # noqa: F401  (part of the public expressions)
from gapfill.operators.profile import missing_profile, missing_summary, shape, summarize_column
from gapfill.session import scratch_path
from gapfill.sources.catalogue import filter_results, parse_catalogue
from gapfill.sources.results import alias_metrics, expand_metrics, read_results, read_run_summary, union_runs, write_run_summary
from gapfill.sources.splits import export_splits, load_split, preview

MAPPING = {"train": "documents.parquet", "test": "conversations.parquet"}


@query("scan_split", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_split(spark, sf):
    return load_split(spark, sf, "train", MAPPING)


def _summary_sql(source: str, columns: dict[str, str], extra: str = "") -> str:
    """Column kinds: s = text, f = floating point, x = other."""
    parts = []
    for name, kind in columns.items():
        null = f"count(*) FILTER (WHERE {name} IS NULL{f' OR isnan({name})' if kind == 'f' else ''})"
        empty = f"count(*) FILTER (WHERE {name} = '')" if kind == "s" else "CAST(0 AS BIGINT)"
        parts.append(
            f"SELECT {extra}'{name}' AS \"column\", {null} AS missing_null, {empty} AS missing_empty, count(*) AS n FROM {source}"
        )
    return " UNION ALL ".join(parts)


_DOCS = {"doc_id": "x", "text": "s", "lang": "s", "source": "s", "n_chars": "x"}
_EV = {"event_id": "x", "user_id": "x", "ts": "x", "value": "f", "event_type": "s"}


@query(
    "export_profile",
    f"""SELECT "column", n AS num_rows, CAST(5 AS BIGINT) AS num_cols, missing_null, missing_empty,
        missing_null + missing_empty AS missing, n - missing_null - missing_empty AS available
        FROM ({_summary_sql('documents', _DOCS)})""",
)
def export_profile(spark, sf):
    out = scratch_path(spark, "export")
    return export_splits({"train": table(spark, sf, "documents")}, out).drop("split", "path")


@query("preview", "SELECT * FROM documents ORDER BY doc_id LIMIT 10")
def preview_rows(spark, sf):
    return preview(table(spark, sf, "documents"), 10, "doc_id")


@query("shape", "SELECT count(*) AS num_rows, CAST(5 AS BIGINT) AS num_cols FROM documents")
def shape_of(spark, sf):
    return shape(table(spark, sf, "documents"))


@query(
    "missing_summary",
    f"""{duck_with('ev_holes')} SELECT "column", missing_null, missing_empty, missing_null + missing_empty AS missing,
        n - missing_null - missing_empty AS available FROM ({_summary_sql('ev_holes', _EV)})""",
)
def missing_summary_of(spark, sf):
    return missing_summary(fixture(spark, sf, "ev_holes"))


@query(
    "summarize_column",
    duck_with("doc_holes")
    + """ SELECT count(*) FILTER (WHERE text IS NULL) AS "null", count(*) FILTER (WHERE text = '') AS empty_string
        FROM doc_holes""",
)
def summarize_text(spark, sf):
    return summarize_column(fixture(spark, sf, "doc_holes"), "text")


_HOLES = {
    "row_id": "x", "text": "s", "target_group": "s", "predicted_author": "s", "toxicity_human": "f", "intent": "f",
    "framing": "s", "actual_method": "s", "dataset": "s",
}


@query(
    "missing_profile",
    duck_with("doc_holes")
    + f""", tagged AS (SELECT *, 'train' AS dataset FROM doc_holes UNION ALL SELECT *, 'test' AS dataset FROM doc_base)
        SELECT "column", missing_null, missing_empty, missing_null + missing_empty AS missing_total,
        n - missing_null - missing_empty AS available, (missing_null + missing_empty) / CAST(n AS DOUBLE) AS missing_ratio
        FROM ({_summary_sql('tagged', _HOLES)})""",
)
def missing_profile_of(spark, sf):
    return missing_profile({"train": fixture(spark, sf, "doc_holes"), "test": fixture(spark, sf, "doc_base")})


_CATALOGUE_SQL = """p AS (
    SELECT path, string_split(regexp_replace(path, '^.*/', ''), '.')[1] AS stem,
           string_split(regexp_replace(path, '^.*/', ''), '.')[2] AS ext, string_split(path, '/')[-2] AS dir FROM names),
  s AS (SELECT *, string_split(stem, '_') AS a, len(string_split(stem, '_')) AS n FROM p WHERE ext = 'parquet'),
  catalogue AS (
    SELECT path, 'train' AS split, 'original' AS mechanism, 'baseline' AS imputer, '00' AS missing_rate, 0 AS position
    FROM s WHERE stem = 'train' AND dir NOT IN ('imputed', 'imputed_llm')
    UNION ALL
    SELECT path, 'train', a[4], CASE WHEN dir = 'imputed_llm' THEN 'llm' ELSE array_to_string(a[5:n-1], '_') END, a[n],
           CASE WHEN dir = 'imputed' THEN 1 ELSE 2 END
    FROM s WHERE dir IN ('imputed', 'imputed_llm') AND n >= 5 AND a[1] = 'train' AND a[2] = 'text')"""


@query(
    "parse_catalogue",
    f"""{duck_with('names')}, {_CATALOGUE_SQL}
        SELECT *, concat_ws('|', split, mechanism, imputer, missing_rate) AS experiment_id FROM catalogue""",
)
def parse_catalogue_of(spark, sf):
    return parse_catalogue(fixture(spark, sf, "names"), root="data")


@query(
    "filter_results",
    f"""{duck_with('runs')} SELECT * FROM runs WHERE lower(imputer) IN ('view', 'error') AND lower(mechanism) = 'mar'
        AND missing_rate IN ('05', '30') ORDER BY event_id LIMIT 500""",
)
def filter_results_of(spark, sf):
    runs = fixture(spark, sf, "runs")
    return filter_results(runs, ["View", "ERROR"], ["MAR"], ["05", "30"], 500, ["event_id"], require=True)


@query(
    "read_results",
    f"""{duck_with('runs')} SELECT CAST(event_id AS VARCHAR) AS experiment_id, split, mechanism, imputer, missing_rate,
        macro_f1, roc_auc, dp_diff, mechanism || '.csv' AS source_file FROM runs""",
)
def read_results_of(spark, sf):
    runs = fixture(spark, sf, "runs").withColumn("experiment_id", F.col("event_id").cast("string")).drop("event_id")
    out = scratch_path(spark, "results")
    cols = ["experiment_id", "split", "mechanism", "imputer", "missing_rate", "macro_f1", "roc_auc", "dp_diff"]
    paths = []
    for mechanism in ("mar", "mcar"):
        path = f"{out}/{mechanism}.csv"
        runs.filter(F.col("mechanism") == mechanism).select(*cols).write.csv(path, header=True)
        paths.append(path)
    return read_results(spark, paths)


def run_maps(spark, sf):
    """Runs with a metric map: absent, empty, partial and full."""
    runs = fixture(spark, sf, "runs")
    full = F.create_map(F.lit("eval_rmse"), F.col("macro_f1"), F.lit("test_rmse"), F.col("roc_auc"))
    part = F.create_map(F.lit("test_rmse"), F.col("roc_auc"))
    kind = F.col("event_id") % 5
    metrics = (
        F.when(kind == 0, F.create_map().cast("map<string,double>"))
        .when(kind == 1, F.lit(None).cast("map<string,double>"))
        .when(kind == 2, part)
        .otherwise(full)
    )
    return runs.select("event_id", "mechanism", "imputer", "missing_rate", metrics.alias("metrics"))


RUN_MAPS_SQL = """run_maps AS (
    SELECT event_id, mechanism, imputer, missing_rate, event_id % 5 NOT IN (0, 1) AS has_metrics,
           CASE WHEN event_id % 5 > 2 THEN macro_f1 END AS eval_rmse,
           CASE WHEN event_id % 5 > 1 THEN roc_auc END AS test_rmse FROM runs)"""


@query(
    "union_run_groups",
    f"""{duck_with('runs')}, {RUN_MAPS_SQL}
        SELECT event_id, mechanism, imputer, missing_rate, eval_rmse AS metric_eval_rmse, test_rmse AS metric_test_rmse,
               'first' AS run_group FROM run_maps WHERE mechanism = 'mar'
        UNION ALL
        SELECT event_id, mechanism, imputer, missing_rate, NULL, test_rmse, 'second' FROM run_maps WHERE mechanism = 'mcar'""",
)
def union_run_groups(spark, sf):
    maps = run_maps(spark, sf)

    def group(mechanism, keys, name):
        own = maps.filter(F.col("mechanism") == mechanism)
        return expand_metrics(own, keys).drop("metrics").withColumn("run_group", F.lit(name))

    return union_runs(group("mar", ["eval_rmse", "test_rmse"], "first"), group("mcar", ["test_rmse"], "second"))


@query(
    "alias_metrics",
    f"""{duck_with('runs')}, {RUN_MAPS_SQL}
        SELECT event_id, coalesce(eval_rmse, test_rmse) AS rmse, CAST(NULL AS DOUBLE) AS roc_auc FROM run_maps""",
)
def alias_metrics_of(spark, sf):
    maps = run_maps(spark, sf)
    return alias_metrics(maps, {"rmse": ["eval_rmse", "test_rmse"], "roc_auc": ["roc_auc", "eval_roc_auc"]}).select(
        "event_id", "rmse", "roc_auc"
    )


@query(
    "run_summaries",
    f"""{duck_with('runs')}, {RUN_MAPS_SQL}
        SELECT mechanism || '_' || imputer || '_' || missing_rate || '_' || (event_id % 40) AS dataset, CAST(0 AS INT) AS exit_code,
               mechanism AS run_group, round(avg(eval_rmse), 6) AS metric_eval_rmse, round(avg(test_rmse), 6) AS metric_test_rmse
        FROM run_maps GROUP BY mechanism, imputer, missing_rate, event_id % 40""",
)
def run_summaries(spark, sf):
    """Batches of runs written as summaries, read back, and their metrics spread without naming any."""
    runs = run_maps(spark, sf).withColumn("part", F.col("event_id") % 40)
    values = {k: F.avg(F.try_element_at("metrics", F.lit(k))) for k in ("eval_rmse", "test_rmse")}
    means = runs.groupBy("mechanism", "imputer", "missing_rate", "part").agg(*(v.alias(k) for k, v in values.items()))
    metrics = F.map_filter(F.create_map(*[x for k in values for x in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    batches = means.select(
        "mechanism", F.concat_ws("_", "mechanism", "imputer", "missing_rate", "part").alias("dataset"), F.lit(None).cast("string").alias("output_dir"),
        F.lit(0).alias("exit_code"), metrics.alias("metrics"),
    )
    read = [
        read_run_summary(spark, write_run_summary(batches.filter(F.col("mechanism") == m).drop("mechanism"), scratch_path(spark, f"summary-{m}")), m)
        for m in ("mar", "mcar")
    ]
    both = union_runs(*(expand_metrics(runs) for runs in read))
    shown = [c for c in both.columns if c.startswith("metric_")]
    return both.select("dataset", "exit_code", "run_group", *(F.round(c, 6).alias(c) for c in shown))
