"""Missingness injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import duck_with, fixture, query, uniform_sql
from gapfill.operators.inject import (
    apply_mask,
    empty_to_null,
    mar_masks,
    mar_weights,
    mcar_mask_columns,
    mcar_masks,
    weighted_sample,
)
from gapfill.operators.profile import inspect_mechanism, version_stats
from gapfill.plans.versions import injection_grid
from gapfill.session import scratch_path
from gapfill.sources.catalogue import read_versions, write_versions

MAR = {
    "thresholds": {"toxicity_human": 4.0, "intent": 4.0, "absent": 1.0},
    "groups": ("fr", "de"),
    "authors": ("src1",),
}
WEIGHT_SQL = """(CAST(1 AS DOUBLE) + CASE WHEN toxicity_human >= 4 THEN 3 ELSE 0 END + CASE WHEN intent >= 4 THEN 3 ELSE 0 END
    + CASE WHEN target_group IN ('fr', 'de') THEN 2 ELSE 0 END
    + CASE WHEN predicted_author = 'src1' THEN CAST(1.5 AS DOUBLE) ELSE 0 END)"""
EXP_SQL = f"(-ln({uniform_sql('row_id')}) / {WEIGHT_SQL})"
ORDERS_SQL = f"""ordered AS (SELECT row_id, row_number() OVER (ORDER BY {uniform_sql('row_id')}, row_id) AS mcar_rn,
    row_number() OVER (ORDER BY {EXP_SQL}, row_id) AS mar_rn, count(*) OVER () AS n FROM doc_base)"""


def _mcar(rate: str) -> str:
    return f"mcar_rn <= greatest(floor(CAST({rate} AS DOUBLE) * n), 1)"


def _mar(rate: str) -> str:
    return f"mar_rn <= round_even(CAST({rate} AS DOUBLE) * n, 0)"


GRID_SQL = f"""{ORDERS_SQL}, masks AS (
    SELECT row_id, 'mcar' AS mechanism, '05' AS missing_rate, CAST(0.05 AS DOUBLE) AS rate, {_mcar('0.05')} AS m FROM ordered
    UNION ALL SELECT row_id, 'mcar', '15', CAST(0.15 AS DOUBLE), {_mcar('0.15')} FROM ordered
    UNION ALL SELECT row_id, 'mcar', '30', CAST(0.30 AS DOUBLE), {_mcar('0.30')} FROM ordered
    UNION ALL SELECT row_id, 'mar', '05', CAST(0.05 AS DOUBLE), {_mar('0.05')} FROM ordered
    UNION ALL SELECT row_id, 'mar', '15', CAST(0.15 AS DOUBLE), {_mar('0.15')} FROM ordered
    UNION ALL SELECT row_id, 'mar', '30', CAST(0.30 AS DOUBLE), {_mar('0.30')} FROM ordered),
  grid AS (SELECT row_id, CASE WHEN m THEN NULL ELSE text END AS text, target_group, predicted_author, toxicity_human,
    intent, nullif(framing, '') AS framing, actual_method, text AS text_original, m AS text_is_missing,
    CASE WHEN m THEN rate ELSE CAST(0 AS DOUBLE) END AS text_missing_rate, mechanism, missing_rate
    FROM doc_base JOIN masks USING (row_id))"""


def grid(spark, sf):
    return injection_grid(fixture(spark, sf, "doc_base"), "row_id", **MAR)


@query("empty_to_null", duck_with("doc_base") + " SELECT row_id, nullif(framing, '') AS framing FROM doc_base")
def empty_to_null_of(spark, sf):
    return empty_to_null(fixture(spark, sf, "doc_base"), ["framing", "absent"]).select("row_id", "framing")


@query(
    "mcar_mask",
    f"""{duck_with('doc_base')}, {ORDERS_SQL} SELECT row_id, {_mcar('0.05')} AS missing_05, {_mcar('0.15')} AS missing_15,
        {_mcar('0.30')} AS missing_30 FROM ordered""",
)
def mcar_mask(spark, sf):
    return mcar_masks(fixture(spark, sf, "doc_base"), "row_id").select("row_id", "missing_05", "missing_15", "missing_30")


@query("mar_weights", f"{duck_with('doc_base')} SELECT row_id, {WEIGHT_SQL} AS weight FROM doc_base")
def mar_weights_of(spark, sf):
    return mar_weights(fixture(spark, sf, "doc_base"), **MAR).select("row_id", "weight")


@query(
    "weighted_sample",
    f"{duck_with('doc_base')}, {ORDERS_SQL} SELECT row_id FROM ordered WHERE mar_rn <= 100",
)
def weighted_sample_of(spark, sf):
    return weighted_sample(fixture(spark, sf, "doc_base"), "row_id", 100, **MAR).select("row_id")


@query(
    "mar_mask",
    f"""{duck_with('doc_base')}, {ORDERS_SQL} SELECT row_id, {_mar('0.05')} AS missing_05, {_mar('0.15')} AS missing_15,
        {_mar('0.30')} AS missing_30 FROM ordered""",
)
def mar_mask(spark, sf):
    return mar_masks(fixture(spark, sf, "doc_base"), "row_id", **MAR).select(
        "row_id", "missing_05", "missing_15", "missing_30"
    )


@query(
    "apply_mask",
    f"""{duck_with('doc_base')}, {GRID_SQL} SELECT row_id, text, text_original, text_is_missing, text_missing_rate FROM grid
        WHERE mechanism = 'mcar' AND missing_rate = '30'""",
)
def apply_mask_of(spark, sf):
    df = fixture(spark, sf, "doc_base")
    masked = apply_mask(df, mcar_mask_columns(df, "row_id", [0.3])[0.3], 0.3)
    return masked.select("row_id", "text", "text_original", "text_is_missing", "text_missing_rate")


@query("injection_grid", f"{duck_with('doc_base')}, {GRID_SQL} SELECT * FROM grid")
def injection_grid_of(spark, sf):
    return grid(spark, sf)


@query(
    "version_stats",
    f"""{duck_with('doc_base')}, {GRID_SQL} SELECT mechanism, missing_rate, count(*) AS num_rows, CAST(11 AS BIGINT) AS num_cols,
        avg(CAST(CAST(text_is_missing AS INT) AS DOUBLE)) AS actual_rate, count(*) FILTER (WHERE text IS NULL) AS text_null,
        count(*) FILTER (WHERE text = '') AS text_empty, count(*) FILTER (WHERE framing IS NULL) AS framing_null,
        count(*) FILTER (WHERE framing = '') AS framing_empty FROM grid GROUP BY ALL""",
)
def version_stats_of(spark, sf):
    return version_stats(grid(spark, sf), ["mechanism", "missing_rate"])


def _share(cond: str, name: str) -> str:
    one = f"CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    return f"round(avg({one}), 6) AS {name}_ratio, round(coalesce(avg({one}) FILTER (WHERE text_is_missing), 0), 6) AS {name}_missing_ratio"


@query(
    "inspect_mechanism",
    f"""{duck_with('doc_base')}, {GRID_SQL} SELECT mechanism, missing_rate, count(*) AS total,
        count(*) FILTER (WHERE text_is_missing) AS missing_count,
        round(avg(CAST(CAST(text_is_missing AS INT) AS DOUBLE)), 6) AS missing_rate_actual,
        {_share('toxicity_human >= 4', 'toxicity_human_high')}, {_share('intent >= 4', 'intent_high')},
        {_share("target_group IN ('fr', 'de')", 'group_focus')}, {_share("predicted_author = 'src1'", 'author_focus')}
        FROM grid GROUP BY mechanism, missing_rate""",
)
def inspect_mechanism_of(spark, sf):
    versions = grid(spark, sf).withColumnRenamed("missing_rate", "tag")
    found = inspect_mechanism(
        versions, ["mechanism", "tag"], {"toxicity_human": 4.0, "intent": 4.0}, ("fr", "de"), "src1"
    )
    ratios = [c for c in found.columns if c.endswith("ratio")]
    return found.select(
        "mechanism",
        F.col("tag").alias("missing_rate"),
        "total",
        "missing_count",
        F.round("missing_rate", 6).alias("missing_rate_actual"),
        *[F.round(c, 6).alias(c) for c in ratios],
    )


_RATES = {0.05: "05", 0.15: "15", 0.3: "30", 1.0: "100"}
_READ_SQL = " UNION ALL ".join(
    f"SELECT row_id, '{name}' AS mechanism, '{tag}' AS missing_rate, CASE WHEN {within(str(rate))} THEN NULL ELSE text END AS text "
    "FROM ordered JOIN doc_base USING (row_id)"
    for name, within in (("mcar", _mcar), ("mar", _mar))
    for rate, tag in _RATES.items()
)


@query("read_versions", f"{duck_with('doc_base')}, {ORDERS_SQL} {_READ_SQL}")
def read_versions_of(spark, sf):
    """Versions of both mechanisms, complete loss included, written as folders and read back."""
    versions = injection_grid(fixture(spark, sf, "doc_base"), "row_id", rates=tuple(_RATES), **MAR)
    path = write_versions(versions, scratch_path(spark, "versions"))
    return read_versions(spark, path).select("row_id", "mechanism", "missing_rate", "text")
