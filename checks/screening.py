"""Screening and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import duck_with, fixture, query, uniform_sql
from checks.inject import grid
from checks.profile import RUN_MAPS_SQL, run_maps
from gapfill.functions.scores import label_bins
from gapfill.functions.text import fill_text, truncate_tokens
from gapfill.operators.classify import class_weights, screen_fit
from gapfill.operators.impute_basic import ConstantImputer, ModeImputer
from gapfill.operators.metrics import dp_diff, macro_f1, regression_metrics, roc_auc_ovr, screen_metrics
from gapfill.operators.regress import RegressConfig, TextRegressor, best_run, regression_prep, sweep
from gapfill.operators.split import stratified_split
from gapfill.plans.screening import run_batch, screen_all, screen_catalogue
from gapfill.plans.versions import impute_grid
from gapfill.sources.catalogue import discover_datasets, load_catalogue, write_versions
from gapfill.session import scratch_path
from gapfill.sources.results import export_predictions, save_results


def bins_sql(x: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {x} >= {t} THEN 1 ELSE 0 END" for t in (1.5, 2.5, 3.5, 4.5)) + ")"


@query("label_bins", f"{duck_with('doc_base')} SELECT row_id, {bins_sql('toxicity_human')} AS label FROM doc_base")
def label_bins_of(spark, sf):
    return fixture(spark, sf, "doc_base").select("row_id", label_bins("toxicity_human").alias("label"))


@query("fill_screen_text", f"{duck_with('doc_holes')} SELECT row_id, coalesce(text, '[MISSING]') AS text FROM doc_holes")
def fill_screen_text(spark, sf):
    return fixture(spark, sf, "doc_holes").select("row_id", fill_text("text").alias("text"))


def split_sql(source: str, key: str, stratum: str, fraction: float) -> str:
    """CTE ``split_(key, held)``: largest remainder per class, ties to the smaller class."""
    return f"""split_n AS (SELECT {stratum} AS s, count(*) AS m, sum(count(*)) OVER () AS n FROM {source} GROUP BY ALL),
      split_k AS (SELECT s, m, n, CAST(ceil(CAST({fraction} AS DOUBLE) * n) AS BIGINT) AS total FROM split_n),
      split_r AS (SELECT s, CAST(total * m // n AS BIGINT) AS base, total,
         row_number() OVER (ORDER BY (total * m) % n DESC, s) AS r FROM split_k),
      split_a AS (SELECT s, base + CASE WHEN r <= total - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM split_r),
      split_ AS (SELECT {key}, row_number() OVER (PARTITION BY {stratum} ORDER BY {uniform_sql(key)}, {key}) <= k AS held
         FROM {source} JOIN split_a ON s = {stratum})"""


@query(
    "stratified_split",
    f"WITH {split_sql('events', 'event_id', 'event_type', 0.2)} SELECT event_id, held AS is_test FROM split_",
)
def stratified_split_of(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return stratified_split(events, "event_id", "event_type", 0.2).select("event_id", "is_test")


@query(
    "class_weights",
    f"""{duck_with('doc_base')}, c AS (SELECT {bins_sql('toxicity_human')} AS label, count(*) AS n FROM doc_base GROUP BY ALL)
        SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * CAST(n AS DOUBLE)), 6) AS weight FROM c""",
)
def class_weights_of(spark, sf):
    df = fixture(spark, sf, "doc_base").select(label_bins("toxicity_human").alias("label"))
    return class_weights(df).withColumn("weight", F.round("weight", 6))


@query("screen_fit")
def screen_fit_of(spark, sf):
    return screen_fit(fixture(spark, sf, "doc_holes"), "row_id")


_BY = "grp, mech"
_F1_SQL = """(SELECT {by}, avg(f1) AS {out} FROM (SELECT {by}, c, 2 * sum(tp) / CAST(sum(t + p) AS DOUBLE) AS f1 FROM (
    SELECT {by}, label AS c, CAST(label = pred AS INT) AS tp, 1 AS t, 0 AS p FROM {src}
    UNION ALL SELECT {by}, pred, 0, 0, 1 FROM {src}) GROUP BY {by}, c) GROUP BY {by})"""


@query(
    "macro_f1",
    f"{duck_with('classed')} SELECT {_BY}, round(macro_f1, 6) AS macro_f1 FROM {_F1_SQL.format(by=_BY, out='macro_f1', src='classed')}",
)
def macro_f1_of(spark, sf):
    return macro_f1(fixture(spark, sf, "classed"), ["grp", "mech"]).withColumn("macro_f1", F.round("macro_f1", 6))


_PROB = "((l_partkey * ({i} + 3) + l_suppkey * 7) % 1009 + 0.5 * CAST({label} = {i} AS INT)) / CAST(1010 AS DOUBLE)"


def with_probs(spark, sf):
    """Five class scores per row, with ties."""
    probs = [F.expr(_PROB.format(i=i, label="label")) for i in range(5)]
    return fixture(spark, sf, "classed").withColumn("probs", F.array(*probs))


_SCORES_SQL = " UNION ALL ".join(
    f"SELECT {_BY}, {i} AS c, label = {i} AS pos, {_PROB.format(i=i, label='label')} AS score FROM classed" for i in range(5)
)
_AUC_SQL = f"""(SELECT {_BY}, CASE WHEN count(auc) = count(*) THEN avg(auc) END AS roc_auc FROM (
    SELECT {_BY}, c, CASE WHEN p > 0 AND n > p THEN (r - p * (p + 1) / CAST(2 AS DOUBLE)) / (p * CAST(n - p AS DOUBLE)) END AS auc
    FROM (SELECT {_BY}, c, count(*) FILTER (WHERE pos) AS p, count(*) AS n, sum(ar) FILTER (WHERE pos) AS r FROM (
      SELECT *, rank() OVER (PARTITION BY {_BY}, c ORDER BY score)
        + (count(*) OVER (PARTITION BY {_BY}, c, score) - 1) / CAST(2 AS DOUBLE) AS ar FROM ({_SCORES_SQL}))
      GROUP BY {_BY}, c)) GROUP BY {_BY})"""


@query("roc_auc_ovr", f"{duck_with('classed')} SELECT {_BY}, round(roc_auc, 6) AS roc_auc FROM {_AUC_SQL}")
def roc_auc_of(spark, sf):
    return roc_auc_ovr(with_probs(spark, sf), ["grp", "mech"]).withColumn("roc_auc", F.round("roc_auc", 6))


_DP_SQL = f"""(SELECT {_BY}, max(r) - min(r) AS dp_diff FROM (SELECT {_BY}, subgroup,
    avg(CAST(CAST(pred >= 3 AS INT) AS DOUBLE)) AS r FROM classed WHERE subgroup IS NOT NULL GROUP BY ALL) GROUP BY {_BY})"""


@query("dp_diff", f"{duck_with('classed')} SELECT {_BY}, round(dp_diff, 6) AS dp_diff FROM {_DP_SQL}")
def dp_diff_of(spark, sf):
    found = dp_diff(fixture(spark, sf, "classed"), ["grp", "mech"], "subgroup")
    return found.withColumn("dp_diff", F.round("dp_diff", 6))


@query(
    "screen_metrics",
    f"""{duck_with('classed')} SELECT {_BY}, round(macro_f1, 6) AS macro_f1, round(roc_auc, 6) AS roc_auc, round(dp_diff, 6) AS dp_diff
        FROM {_F1_SQL.format(by=_BY, out='macro_f1', src='classed')} JOIN {_AUC_SQL} USING (grp, mech) JOIN {_DP_SQL} USING (grp, mech)""",
)
def screen_metrics_of(spark, sf):
    found = screen_metrics(with_probs(spark, sf), ["grp", "mech"], "subgroup")
    return found.select("grp", "mech", *[F.round(c, 6).alias(c) for c in ("macro_f1", "roc_auc", "dp_diff")])


def filled_versions(spark, sf):
    """Both simple imputers over both mechanisms at all rates; made where they are read, as written they are two dozen copies of the texts."""
    imputers = {"simple_placeholder": ConstantImputer(), "simple_most_frequent": ModeImputer()}
    return impute_grid(grid(spark, sf), imputers, "row_id").withColumn("split", F.lit("train"))


@query("screen_all")
def screen_all_of(spark, sf):
    return screen_all(filled_versions(spark, sf), "row_id")


@query("save_results", f"{duck_with('runs')} SELECT * FROM runs")
def save_results_of(spark, sf):
    runs = fixture(spark, sf, "runs")
    path = save_results(runs, scratch_path(spark, "saved"))
    return spark.read.schema(runs.schema).csv(path, header=True)


def parts_of(spark, sf):
    return regression_prep(fixture(spark, sf, "doc_holes"), "row_id", fixture(spark, sf, "doc_base"))


_PREP = f"""prep AS (SELECT row_id, text, toxicity_human AS label, {bins_sql('toxicity_human')} AS b FROM doc_holes),
    {split_sql('prep', 'row_id', 'b', 0.1)}"""


@query(
    "regression_prep",
    f"""{duck_with('doc_holes')}, {_PREP}
        SELECT row_id, text, label, CASE WHEN held THEN 'validation' ELSE 'train' END AS part FROM prep JOIN split_ USING (row_id)
        UNION ALL SELECT row_id, text, toxicity_human, 'test' FROM doc_base""",
)
def regression_prep_of(spark, sf):
    return parts_of(spark, sf)


@query(
    "truncate_tokens",
    """SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')[1:256], ' ') AS tokens FROM documents""",
)
def truncate_tokens_of(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.array_join(truncate_tokens("text"), " ").alias("tokens"))


@query("fit_regressor")
def fit_regressor(spark, sf):
    return TextRegressor().fit(parts_of(spark, sf), "row_id").predictions


@query("export_predictions", f"{duck_with('ratings')} SELECT pred, label FROM ratings")
def export_predictions_of(spark, sf):
    path = scratch_path(spark, "predictions")
    export_predictions(fixture(spark, sf, "ratings"), path)
    return spark.read.schema("pred double, label double").csv(path, header=True)


_RANK = """rank() OVER (PARTITION BY grp, mech ORDER BY {x}) + (count(*) OVER (PARTITION BY grp, mech, {x}) - 1) / CAST(2 AS DOUBLE)"""


@query(
    "regression_metrics",
    f"""{duck_with('ratings')}, ranked AS (SELECT *, {_RANK.format(x='label')} AS rl, {_RANK.format(x='pred')} AS rp FROM ratings),
      binned AS (SELECT {_BY}, {bins_sql('label')} AS label, {bins_sql('pred')} AS pred FROM ratings)
      SELECT {_BY}, round(avg(abs(label - pred)), 6) AS mae, round(sqrt(avg((label - pred) ** 2)), 6) AS rmse,
        round(corr(label, pred), 6) AS pearson, round(corr(rl, rp), 6) AS spearman,
        round(any_value(f1), 6) AS macro_f1_from_regression
      FROM ranked JOIN {_F1_SQL.format(by=_BY, out='f1', src='binned')} USING (grp, mech) GROUP BY {_BY}""",
)
def regression_metrics_of(spark, sf):
    found = regression_metrics(fixture(spark, sf, "ratings"), ["grp", "mech"])
    return found.select("grp", "mech", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("grp", "mech")])


@query("sweep")
def sweep_of(spark, sf):
    return sweep(parts_of(spark, sf), "row_id", {"reg": (0.01, 0.1), "elastic_net": (0.0, 0.5)})


@query(
    "best_run",
    f"""{duck_with('runs')}, {RUN_MAPS_SQL} SELECT event_id, mechanism, imputer, missing_rate FROM run_maps WHERE has_metrics
        ORDER BY coalesce(eval_rmse, CAST('inf' AS DOUBLE)), event_id LIMIT 1""",
)
def best_run_of(spark, sf):
    return best_run(run_maps(spark, sf), order="event_id").drop("metrics")


@query("run_batch")
def run_batch_of(spark, sf):
    """Both imputers, mechanisms and all rates as datasets of their own."""
    filled = filled_versions(spark, sf)
    names = filled.select("imputer", "mechanism", "missing_rate").distinct().collect()
    versions = {
        f"{r.imputer}_{r.mechanism}_{r.missing_rate}": filled.filter(
            (F.col("imputer") == r.imputer) & (F.col("mechanism") == r.mechanism) & (F.col("missing_rate") == r.missing_rate)
        )
        for r in names
    }
    return run_batch(versions, "row_id", fixture(spark, sf, "doc_base"), RegressConfig())


@query(
    "screen_catalogue_inputs",
    """WITH n AS (SELECT count(*) AS n FROM documents)
        SELECT unnest(['train|original|baseline|00', 'train|mar|simple_placeholder|30', 'train|mcar|llm|05', 'train|mcar|knn|100',
                       'train|mcar|knn|15']) AS experiment_id, n AS num_rows, CAST(5 AS BIGINT) AS num_cols FROM n""",
)
def screen_catalogue_inputs(spark, sf):
    """Datasets of every layout, written by Spark, discovered, loaded and counted."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    root = scratch_path(spark, "catalogue")
    for name in ("train.parquet", "other/train.parquet", "imputed/train_text_imputed_mar_simple_placeholder_30.parquet",
                 "imputed_llm/train_text_imputed_mcar_05.parquet", "imputed/notes.parquet"):
        docs.write.parquet(f"{root}/{name}")
    tags = docs.withColumns({"mechanism": F.lit("mcar"), "imputer": F.lit("knn")})
    both = tags.withColumn("missing_rate", F.lit("15")).unionByName(tags.withColumn("missing_rate", F.lit("100")))
    write_versions(both, f"{root}/versions")
    loaded = load_catalogue(spark, discover_datasets(spark, root))
    width = len([c for c in loaded.columns if c in docs.columns])
    return loaded.groupBy("experiment_id").agg(F.count("*").alias("num_rows"), F.lit(width).cast("long").alias("num_cols"))


@query("screen_catalogue")
def screen_catalogue_of(spark, sf):
    """The baseline and two filled versions as files: discovered, loaded, screened, saved, the best five given."""
    root = scratch_path(spark, "catalogue")
    fixture(spark, sf, "doc_base").write.parquet(f"{root}/train.parquet")
    filled = filled_versions(spark, sf).filter("imputer = 'simple_most_frequent' and missing_rate = '30'")
    write_versions(filled.drop("split", "was_filled"), f"{root}/versions")
    path, best = screen_catalogue(spark, discover_datasets(spark, root), "row_id", scratch_path(spark, "screened"))
    saved = spark.read.csv(path, header=True).select("experiment_id")
    return best.join(saved, "experiment_id")
