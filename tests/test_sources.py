import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gapfill.plans.versions import injection_grid
from gapfill.session import gather, in_parallel, materialize, scratch, scratch_root
from gapfill.sources.catalogue import discover_datasets, filter_results, load_catalogue, parse_catalogue, read_versions, write_versions
from gapfill.sources.results import (
    alias_metrics,
    expand_metrics,
    export_predictions,
    read_log,
    read_results,
    read_run_summary,
    save_results,
    union_runs,
    write_log,
    write_run_summary,
)
from gapfill.sources.splits import export_splits, load_split, preview


def small(spark, n=5):
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


def test_splits(spark, tmp_path):
    root = str(tmp_path)
    info = export_splits({"train": small(spark), "test": small(spark, 2)}, root)
    assert {(r["split"], r["num_rows"], r["num_cols"]) for r in info.collect()} == {("train", 5, 2), ("test", 2, 2)}
    both = load_split(spark, root)
    assert {k: v.count() for k, v in both.items()} == {"train": 5, "test": 2}
    assert load_split(spark, root, "test").count() == 2
    with pytest.raises(KeyError, match="test.*train"):
        load_split(spark, root, "dev")
    with pytest.raises(ValueError):
        export_splits({}, root, "xlsx")
    only = export_splits({"train": small(spark), "test": small(spark)}, root + "/csv", "csv", only="test")
    assert {r["split"] for r in only.collect()} == {"test"}


def test_preview(spark):
    assert preview(small(spark), 99).count() == 5
    assert [r[0] for r in preview(small(spark), 2, "row_id").collect()] == [0, 1]
    with pytest.raises(ValueError):
        preview(small(spark), 0)


def test_versions_round_trip(spark, tmp_path):
    out = str(tmp_path / "versions")
    write_versions(injection_grid(small(spark, 20), "row_id"), out)
    back = read_versions(spark, out)
    one = back.filter((F.col("mechanism") == "mcar") & (F.col("missing_rate") == "05"))
    assert one.count() == 20 and one.filter("text_is_missing").count() == 1


def test_catalogue(spark, tmp_path):
    for rel in ("train.parquet", "imputed/train_text_imputed_mar_simple_most_frequent_05.parquet", "imputed/train_text_bad.parquet",
                "imputed_llm/train_text_imputed_mcar_30.parquet", "imputed/train_text_imputed_mar_knn_15.csv"):
        path = tmp_path / "d" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = [r["experiment_id"] for r in discover_datasets(spark, str(tmp_path / "d")).collect()]
    assert got == ["train|original|baseline|00", "train|mar|simple_most_frequent|05", "train|mcar|llm|30"]
    cat = parse_catalogue(spark.createDataFrame([("a/train.parquet",), ("train.parquet",)], "path string"))
    assert [r["path"] for r in cat.collect()] == ["train.parquet"]
    assert filter_results(cat, imputers=["BASELINE"], limit=1).count() == 1
    with pytest.raises(ValueError):
        filter_results(cat, rates=["5"], require=True)


def test_datasets_that_spark_writes(spark, tmp_path):
    root = str(tmp_path / "root")
    for name in ("train.parquet", "r/other/train.parquet", "imputed/train_text_imputed_mar_knn_05.parquet"):
        small(spark).write.parquet(f"{root}/{name}")
    write_versions(injection_grid(small(spark, 10), "row_id", rates=(0.1, 1.0)), f"{root}/grid")
    cat = discover_datasets(spark, root)
    want = ["train|original|baseline|00", "train|mar|knn|05", "train|mar|none|10", "train|mar|none|100", "train|mcar|none|10", "train|mcar|none|100"]
    assert sorted(r["experiment_id"] for r in cat.collect()) == sorted(want)
    rows = {r["experiment_id"]: r["count"] for r in load_catalogue(spark, cat).groupBy("experiment_id").count().collect()}
    assert rows == {w: 10 if "none" in w else 5 for w in want}


def test_complete_loss_round_trips(spark, tmp_path):
    write_versions(injection_grid(small(spark, 20), "row_id", ("mcar",), rates=(0.1, 1.0)), str(tmp_path / "v"))
    back = read_versions(spark, str(tmp_path / "v")).groupBy("missing_rate").count().collect()
    assert {r["missing_rate"]: r["count"] for r in back} == {"10": 20, "100": 20}


def test_repeated_keys_are_refused(spark):
    with pytest.raises(ValueError, match="unique"):
        injection_grid(small(spark).unionAll(small(spark)), "row_id")


def test_metrics_of_odd_files(spark, tmp_path):
    texts = {"mixed.json": '[{"dataset": "a", "exit_code": 0, "metrics": {"eval_rmse": "n/a", "test_rmse": 0.2}}]', "bad.json": "{oops",
             "flat.json": '{"eval_rmse": 1.5, "epoch": 3}', "one.json": '{"dataset": "b", "metrics": null}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = {n: [(r["dataset"], dict(r["metrics"])) for r in read_run_summary(spark, str(tmp_path / n)).collect()] for n in texts}
    assert rows == {"mixed.json": [("a", {"test_rmse": 0.2})], "bad.json": [], "flat.json": [(None, {"eval_rmse": 1.5, "epoch": 3.0})], "one.json": [("b", {})]}
    runs = spark.createDataFrame([("x", "o", 0, {"m": 1.0}, None), ("y", None, 1, {}, "failed")], "dataset string, output_dir string, exit_code int, metrics map<string,double>, error string")
    back = read_run_summary(spark, write_run_summary(runs, str(tmp_path / "summary.json"))).collect()
    assert [(r["dataset"], r["output_dir"], r["exit_code"], dict(r["metrics"])) for r in back] == [("x", "o", 0, {"m": 1.0}), ("y", None, 1, {})]


def test_scratch_is_deleted(spark):
    with scratch(spark):
        path = materialize(small(spark), "gone").inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def result_rows(spark):
    return spark.createDataFrame(
        [("e", "train", "mar", "knn", "05", 0.5, None, 0.1)],
        "experiment_id string, split string, mechanism string, imputer string, missing_rate string, macro_f1 double, roc_auc double, dp_diff double",
    )


def test_results_round_trip(spark, tmp_path):
    path = save_results(result_rows(spark), str(tmp_path), datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("screening_results_20240102_030405.csv")
    row = read_results(spark, [path]).first()
    assert row["missing_rate"] == "05" and row["roc_auc"] is None and row["source_file"] == "screening_results_20240102_030405.csv"
    single = tmp_path / "plain.csv"
    single.write_text("experiment_id,split,mechanism,imputer,missing_rate,macro_f1,roc_auc,dp_diff\ne,s,m,i,15,1,1,1\n")
    names = {r["source_file"] for r in read_results(spark, [path, str(single)]).collect()}
    assert names == {"plain.csv", "screening_results_20240102_030405.csv"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_results(spark, [str(tmp_path / "none.csv")]).collect()


def test_run_summaries(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"dataset": "x", "output_dir": "o", "exit_code": 0, "metrics": {"eval_rmse": 0.5}},
        {"dataset": "y", "exit_code": 1, "metrics": {}},
        {"dataset": "z", "exit_code": 1},
    ], indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"epochs": 3, "batch_size": 8, "exit_code": 0, "metrics": {"test_rmse": 1.5}}]))
    a = read_run_summary(spark, str(tmp_path / "a.json"), "first")
    b = read_run_summary(spark, str(tmp_path / "b.json"), "second")
    assert [dict(r["metrics"]) for r in a.collect()] == [{"eval_rmse": 0.5}, {}, {}]
    both = union_runs(expand_metrics(a, ["eval_rmse"]), expand_metrics(b, ["test_rmse"]))
    out = alias_metrics(both, {"rmse": ["eval_rmse", "test_rmse"], "none": ["q"]}).collect()
    assert [r["rmse"] for r in out] == [0.5, None, None, 1.5] and all(r["none"] is None for r in out)


def test_log_and_predictions(spark, tmp_path):
    log = spark.createDataFrame([("2", 1, "p", None), ("1", 1, "ü", "c")], "row_index string, attempt int, prompt string, completion string")
    write_log(log, str(tmp_path / "log"))
    assert [r["prompt"] for r in read_log(spark, str(tmp_path / "log"), 5).collect()] == ["ü", "p"]
    export_predictions(spark.createDataFrame([(1.0, 2.0)], "label double, pred double"), str(tmp_path / "pred"))
    assert spark.read.csv(str(tmp_path / "pred"), header=True).columns == ["pred", "label"]


def test_scratch(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(small(spark), "t")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert in_parallel([lambda: 1, lambda: 2, lambda: 3]) == [1, 2, 3]
    assert gather(small(spark), 10).rdd.getNumPartitions() == 1


def test_metric_names_are_found(spark, monkeypatch):
    from gapfill.sources import results

    rows = [(1, {"eval_rmse": 0.5, "z": 1.0}), (2, {"test_mae": 2.0}), (3, {}), (4, None)]
    df = spark.createDataFrame(rows, "id int, metrics map<string,double>")
    assert results.metric_keys(df) == ["eval_rmse", "test_mae", "z"]
    got = results.expand_metrics(df).drop("metrics").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, None, 1.0), (2, None, 2.0, None), (3, None, None, None), (4, None, None, None)]
    monkeypatch.setattr(results, "MAX_METRICS", 2)
    with pytest.raises(ValueError):
        results.metric_keys(df)


def test_versions_are_written_small_and_without_a_sort(spark, tmp_path):
    from gapfill.sources.catalogue import read_versions, write_versions

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(i, "t", m, r) for i in range(20) for m in ("mar", "mcar") for r in ("05", "100")], "k int, text string, mechanism string, missing_rate string")
    path = write_versions(df, str(tmp_path / "v"))
    assert spark.conf.get(name) == before and all(".zstd." in f.name for f in (tmp_path / "v").rglob("*.parquet"))
    assert sorted(map(tuple, read_versions(spark, path).select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_filled_versions_train_without_being_written(spark):
    from checks.screening import filled_versions
    from gapfill import session
    from gapfill.plans.screening import run_batch

    before = len(session._WRITTEN)
    filled = filled_versions(spark, "/root/testdata/sf0.001")
    one = filled.filter("imputer = 'simple_most_frequent' and mechanism = 'mar' and missing_rate = '30'")
    assert one.count() == 200 and not [p for p in session._WRITTEN[before:] if "/versions-" in p or "/filled-" in p]
    assert run_batch({"one": one}, "row_id").first()["exit_code"] == 0
