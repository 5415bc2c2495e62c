"""Basic imputation and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import duck_with, fixture, query
from checks.inject import GRID_SQL, grid
from gapfill.functions.text import is_blank
from gapfill.operators.impute_basic import ConstantImputer, ModeImputer, fill_diff, propagate_fills
from gapfill.operators.inject import apply_mask, mcar_mask_columns
from gapfill.plans.versions import impute_grid

BLANK = "(text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '')"


def _mode(source: str) -> str:
    return f"""(SELECT text FROM {source} WHERE NOT {BLANK} GROUP BY text ORDER BY count(*) DESC, text LIMIT 1)"""


def flagship(spark, sf):
    df = fixture(spark, sf, "doc_base")
    masked = apply_mask(df, mcar_mask_columns(df, "row_id", [0.3])[0.3], 0.3)
    filled = ModeImputer().fit(masked).transform(masked)
    return filled.groupBy("target_group").agg(
        F.count("*").alias("num_rows"),
        F.count_if("was_filled").alias("num_filled"),
        F.count_if(is_blank("text")).alias("num_blank"),
    )


@query(
    "mask_and_fill",
    f"""{duck_with('doc_base')}, {GRID_SQL} SELECT target_group, count(*) AS num_rows,
        count(*) FILTER (WHERE text_is_missing) AS num_filled, CAST(0 AS BIGINT) AS num_blank FROM grid
        WHERE mechanism = 'mcar' AND missing_rate = '30' GROUP BY target_group""",
)
def mask_and_fill(spark, sf):
    return flagship(spark, sf)


@query("blank_mask", f"{duck_with('doc_holes')} SELECT row_id, {BLANK} AS is_blank FROM doc_holes")
def blank_mask(spark, sf):
    return fixture(spark, sf, "doc_holes").select("row_id", is_blank("text").alias("is_blank"))


@query(
    "impute_constant",
    f"""{duck_with('doc_holes')} SELECT row_id, CASE WHEN {BLANK} THEN '[MISSING_TEXT]' ELSE text END AS text,
        {BLANK} AS was_filled FROM doc_holes""",
)
def impute_constant(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    return ConstantImputer().fit(df).transform(df).select("row_id", "text", "was_filled")


@query(
    "impute_mode",
    f"""{duck_with('doc_holes')} SELECT row_id, CASE WHEN {BLANK} THEN {_mode('doc_holes')} ELSE text END AS text,
        {BLANK} AS was_filled FROM doc_holes""",
)
def impute_mode(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    return ModeImputer().fit(df).transform(df).select("row_id", "text", "was_filled")


# Per mechanism: the mode of its 30 % version fills all of its blanks (the masks nest).
_GRIDS = f"""{GRID_SQL}, primaries AS (SELECT * FROM grid WHERE missing_rate = '30'),
  modes AS (SELECT mechanism, text AS mode FROM (
     SELECT mechanism, text, row_number() OVER (PARTITION BY mechanism ORDER BY count(*) DESC, text) AS r
     FROM primaries WHERE NOT {BLANK} GROUP BY mechanism, text) WHERE r = 1)"""


@query(
    "propagate_fills",
    f"""{duck_with('doc_base')}, {_GRIDS} SELECT row_id, CASE WHEN {BLANK} THEN mode ELSE text END AS text,
        {BLANK} AS was_filled FROM grid JOIN modes USING (mechanism)
        WHERE mechanism = 'mar' AND missing_rate = '15'""",
)
def propagate(spark, sf):
    versions = grid(spark, sf).filter(F.col("mechanism") == "mar")
    primary = versions.filter(F.col("missing_rate") == "30")
    filled = ModeImputer().fit(primary).transform(primary)
    target = versions.filter(F.col("missing_rate") == "15")
    return propagate_fills(target, filled, "row_id").select("row_id", "text", "was_filled")


@query(
    "impute_grid",
    f"""{duck_with('doc_base')}, {_GRIDS}
        SELECT row_id, mechanism, missing_rate, 'simple_placeholder' AS imputer,
               CASE WHEN {BLANK} THEN '[MISSING_TEXT]' ELSE text END AS text, {BLANK} AS was_filled FROM grid
        UNION ALL
        SELECT row_id, mechanism, missing_rate, 'simple_most_frequent',
               CASE WHEN {BLANK} THEN mode ELSE text END, {BLANK} FROM grid JOIN modes USING (mechanism)""",
)
def impute_grid_of(spark, sf):
    imputers = {"simple_placeholder": ConstantImputer(), "simple_most_frequent": ModeImputer()}
    versions = grid(spark, sf)  # cheap to make again; written, it is a dozen copies of the texts
    return impute_grid(versions, imputers, "row_id").select(
        "row_id", "mechanism", "missing_rate", "imputer", "text", "was_filled"
    )


@query(
    "fill_diff",
    f"""{duck_with('doc_holes')} SELECT row_id, text AS text_before, {_mode('doc_holes')} AS text_after FROM doc_holes
        WHERE {BLANK}""",
)
def fill_diff_of(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    return fill_diff(df, ModeImputer().fit(df).transform(df), "row_id")
