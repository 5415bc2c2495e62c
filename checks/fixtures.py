"""Derived tables, written once as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_CLEAN = "regexp_replace(text, '[^A-Za-z ]', ' ')"

FIXTURES: dict[str, str] = {
    # an annotated text table; ratings hit the bin edges exactly
    "doc_base": """
        select d.doc_id as row_id, d.text, d.lang as target_group, d.source as predicted_author,
               cast(1 as double) + (d.n_chars % 9) * cast(0.5 as double) as toxicity_human,
               cast(1 as double) + 2 * coalesce(l.toxic, 0) + 2 * (1 - coalesce(l.quality, 1)) as intent,
               case d.doc_id % 4 when 0 then '' when 1 then null when 2 then 'moral' else 'cause' end as framing,
               case d.doc_id % 2 when 0 then 'topk' else 'cbs' end as actual_method
        from documents d left join labels l on d.doc_id = l.doc_id""",
    # the same with null, empty and blank texts
    "doc_holes": """
        select row_id, case row_id % 10 when 3 then null when 6 then '' when 9 then '  ' else text end as text,
               target_group, predicted_author, toxicity_human, intent, framing, actual_method
        from doc_base""",
    # numbers with null and NaN, texts with empty strings
    "ev_holes": """
        select event_id, user_id, ts,
               case event_id % 7 when 2 then null when 5 then cast('NaN' as double) else value end as value,
               case event_id % 5 when 1 then '' else event_type end as event_type
        from events""",
    # two incomplete numeric columns that depend on each other
    "ev_numeric": """
        select event_id,
               case event_id % 7 when 2 then null else value end as value,
               case event_id % 5 when 1 then null else value * 2 + (user_id % 13) end as score,
               cast(user_id % 13 as double) as bucket
        from events""",
    # large classification and regression outputs
    "ratings": """
        select l_returnflag as grp, l_linestatus as mech, l_quantity / 10 as label,
               l_quantity / 10 + (l_partkey % 7 - 3) * cast(0.25 as double) as pred, l_partkey, l_suppkey
        from lineitem""",
    "classed": """
        select grp, mech, cast(l_suppkey % 20 as varchar(10)) as subgroup, l_partkey, l_suppkey,
               (case when label >= 1.5 then 1 else 0 end + case when label >= 2.5 then 1 else 0 end
                + case when label >= 3.5 then 1 else 0 end + case when label >= 4.5 then 1 else 0 end) as label,
               (case when pred >= 1.5 then 1 else 0 end + case when pred >= 2.5 then 1 else 0 end
                + case when pred >= 3.5 then 1 else 0 end + case when pred >= 4.5 then 1 else 0 end) as pred
        from ratings""",
    # a large experiment table
    "runs": """
        select event_id, 'train' as split, case when user_id % 2 = 0 then 'mar' else 'mcar' end as mechanism,
               event_type as imputer,
               case event_id % 3 when 0 then '05' when 1 then '15' else '30' end as missing_rate,
               value / 1000 as macro_f1, (event_id % 101) / cast(100 as double) as roc_auc,
               (event_id % 41 - 20) / cast(100 as double) as dp_diff
        from events""",
    # paths of dataset files, some of them malformed
    "names": """
        select event_id, case event_id % 7
                 when 0 then 'data/train.parquet'
                 when 1 then concat('data/imputed/train_text_imputed_', mechanism, '_', imputer, '_', missing_rate, '.parquet')
                 when 2 then concat('data/imputed_llm/train_text_imputed_', mechanism, '_', missing_rate, '.parquet')
                 when 3 then 'data/imputed/train_text_bad.parquet'
                 when 4 then concat('data/imputed/test_text_imputed_', mechanism, '_knn_', missing_rate, '.parquet')
                 when 5 then concat('data/imputed/train_text_imputed_', mechanism, '_simple_most_frequent_', missing_rate, '.parquet')
                 else concat('data/imputed/train_text_imputed_', mechanism, '_knn_', missing_rate, '.csv') end as path,
               macro_f1, roc_auc
        from runs""",
    # provider answers: good JSON, embedded JSON, raw text, wrong type, empty
    "completions": f"""
        select conv_id * 1000 + turn as row_id, conv_id, turn, case (conv_id + turn) % 5
               when 0 then concat('{{"text": "', {_CLEAN}, '"}}') when 1 then concat('Sure: {{"text": "', {_CLEAN}, '"}} done')
               when 2 then {_CLEAN} when 3 then '{{"text": 5}}' else '' end as completion
        from conversations""",
}

_NEEDS = {
    "doc_holes": ("doc_base",),
    "names": ("runs",),
    "classed": ("ratings",),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in (*_closure(_NEEDS.get(name, ())), name):
            if n not in out:
                out.append(n)
    return out


def duck_with(*names: str) -> str:
    """``WITH`` clause head defining fixtures for DuckDB (no trailing comma)."""
    parts = []
    for n in _closure(names):
        sql = FIXTURES[n].replace("'[^A-Za-z ]', ' ')", "'[^A-Za-z ]', ' ', 'g')")
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ", ".join(parts)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived table over the Parquet files of ``sf``; lazily, as a chain of views."""
    for t in TABLES:
        if t in "documents labels events lineitem conversations".split():
            table(spark, sf, t).createOrReplaceTempView(t)
    for n in _closure((name,)):
        spark.sql(FIXTURES[n]).createOrReplaceTempView(n)
    return spark.table(name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL it must agree with."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def uniform_sql(key: str, seed: int = 42) -> str:
    bits = f"CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT)"
    return f"((CAST({bits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))"
