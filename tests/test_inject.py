import math

import pytest
from pyspark.sql import functions as F

import gapfill.operators.select as select
from gapfill.functions.scores import uniform
from gapfill.operators.inject import apply_mask, mar_masks, mar_weights, mcar_mask_columns, mcar_masks, mcar_size
from gapfill.operators.profile import missing_summary, summarize_column
from gapfill.operators.split import allot, stratified_split
from gapfill.plans.versions import injection_grid


def rows_of(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        (F.col("id") % 5 + 1).cast("double").alias("toxicity_human"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("target_group"),
    )


@pytest.mark.parametrize("parts", [1, 7])
def test_masks_nest_and_have_exact_sizes(spark, parts):
    df = rows_of(spark, 333).repartition(parts)
    for masks, size in ((mcar_masks(df, "row_id"), math.floor), (mar_masks(df, "row_id", thresholds={"toxicity_human": 4.0}), round)):
        pdf = masks.toPandas()
        for rate, tag in ((0.05, "05"), (0.15, "15"), (0.30, "30")):
            assert pdf[f"missing_{tag}"].sum() == size(rate * 333)
        assert (~pdf.missing_05 | pdf.missing_15).all() and (~pdf.missing_15 | pdf.missing_30).all()


def test_masks_do_not_depend_on_partitions(spark):
    df = rows_of(spark, 200)
    a = {r[0] for r in mcar_masks(df.repartition(1), "row_id").filter("missing_30").select("row_id").collect()}
    b = {r[0] for r in mcar_masks(df.repartition(13), "row_id").filter("missing_30").select("row_id").collect()}
    assert a == b


def test_sizes_at_the_edges(spark):
    one, none = rows_of(spark, 1), rows_of(spark, 0)
    assert mcar_masks(one, "row_id", [0.05]).first()["missing_05"] is True
    assert mar_masks(one, "row_id", [0.05]).first()["missing_05"] is False
    assert mcar_masks(none, "row_id", [0.05]).count() == 0
    assert mcar_size(0.0, 10) == 0 and mcar_size(1.0, 10) == 10
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            mcar_masks(one, "row_id", [bad])
    all_ = mcar_masks(rows_of(spark, 9), "row_id", [0.0, 1.0]).toPandas()
    assert all_.missing_100.all() and not all_.missing_00.any()


def test_narrowing_finds_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(select, "SMALL", 3)
    monkeypatch.setattr(select, "BUCKETS", 4)
    df = rows_of(spark, 500)
    masks = mcar_mask_columns(df, "row_id", [0.05, 0.3])
    for rate, mask in masks.items():
        want = [r[0] for r in df.orderBy(uniform("row_id", 42), "row_id").limit(int(rate * 500)).collect()]
        assert sorted(want) == sorted(r[0] for r in df.filter(mask).collect())


def test_ties_fall_back_to_the_key(spark, monkeypatch):
    monkeypatch.setattr(select, "SMALL", 3)
    cuts, _ = select.smallest_k_cuts(rows_of(spark, 50), F.lit(1.0), "row_id", lambda c: {0: [7]})
    assert cuts[(0, 7)].key == 6


def test_repeated_keys_raise(spark):
    df = rows_of(spark, 1).union(rows_of(spark, 1))
    with pytest.raises(ValueError, match="unique"):
        mcar_masks(df, "row_id", [0.5])


def test_weights_ignore_nan_text_and_absent_columns(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), "abc"), (2, None, "5"), (3, 4.0, "4"), (4, 3.9, None)], "row_id long, toxicity_human double, intent string"
    )
    got = {r["row_id"]: r["weight"] for r in mar_weights(df, thresholds={"toxicity_human": 4.0, "intent": 4.0, "x": 0.0}).collect()}
    assert got == {1: 1.0, 2: 4.0, 3: 7.0, 4: 1.0}


def test_mar_prefers_triggers(spark):
    pdf = mar_masks(rows_of(spark, 2000), "row_id", [0.3], thresholds={"toxicity_human": 4.0}).toPandas()
    high = pdf.toxicity_human >= 4
    assert pdf[high].missing_30.mean() > 1.5 * pdf[~high].missing_30.mean()


def test_apply_mask(spark):
    df = rows_of(spark, 10)
    out = apply_mask(df, F.col("row_id") < 3, 0.3).toPandas()
    assert out.text.isna().sum() == 3 and (out.text_original == "text " + out.row_id.astype(str)).all()
    assert set(out.text_missing_rate) == {0.0, 0.3}
    with pytest.raises(KeyError):
        apply_mask(df.drop("text"), F.lit(True), 0.3)


def test_grid_is_narrow(spark):
    grid = injection_grid(rows_of(spark, 100), "row_id")
    assert grid.count() == 600
    assert "Exchange" not in grid._jdf.queryExecution().executedPlan().toString()


def test_profiles(spark):
    df = spark.createDataFrame([(None, float("nan")), ("", 1.0), (" ", None)], "t string, x double")
    got = {r["column"]: (r["missing_null"], r["missing_empty"], r["available"]) for r in missing_summary(df).collect()}
    assert got == {"t": (1, 1, 1), "x": (2, 0, 1)}
    empty = {r["column"]: r["available"] for r in missing_summary(df.limit(0)).collect()}
    assert empty == {"t": 0, "x": 0}
    with pytest.raises(KeyError):
        summarize_column(df, "none")


def test_stratified_split(spark):
    assert allot({0: 5, 1: 5, 2: 3}, 0.2) == {0: 1, 1: 1, 2: 1}
    assert allot({}, 0.2) == {}
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 90, 0).otherwise(1).alias("c"))
    pdf = stratified_split(df, "k", "c", 0.2).toPandas()
    assert pdf[pdf.is_test].groupby("c").size().to_dict() == {0: 18, 1: 2}


def test_any_number_of_strata(spark, monkeypatch):
    from gapfill.operators import split

    df = spark.range(6_000).select(F.col("id").alias("k"), F.when(F.col("id") % 5 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 1_500)).alias("c"))
    plain = {r["k"]: r["is_test"] for r in split.stratified_split(df, "k", "c", 0.2).collect()}
    assert len(plain) == 6_000 and sum(plain.values()) == 1_200
    by = {}
    for r in df.collect():
        by.setdefault(r["c"], []).append(plain[r["k"]])
    sizes = allot({c: len(v) for c, v in by.items()}, 0.2)
    assert {c: sum(v) for c, v in by.items()} == sizes
    monkeypatch.setattr(split, "WINDOW_ROWS", 100)  # the large stratum goes by its histogram
    assert {r["k"]: r["is_test"] for r in split.stratified_split(df, "k", "c", 0.2).collect()} == plain
