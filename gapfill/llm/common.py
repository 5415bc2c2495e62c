"""Helpers the operators share."""

from __future__ import annotations

import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python works on at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once per row however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns; columns that have their names already (in any case) make way."""
    names = {n.lower() for n in columns}
    return df.select(
        *(df[f"`{c}`"] for c in df.columns if c.lower() not in names), *(v.alias(n) for n, v in columns.items())
    )


def map_slices(df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """``work`` over slices of rows: columns as lists in, columns as lists out, streamed by Arrow.

    A slice has at most ``BATCH_ROWS`` rows, so what Python holds at once is bounded by the longest texts.
    """
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                got = work({n: rows.column(i).to_pylist() for i, n in enumerate(rows.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, kind)


def by_bytes(batch, column: int, most: int):
    """Slices of an Arrow batch whose strings in ``column`` come to about ``most`` bytes; a longer one is alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across the tasks it runs."""
    import sys

    home = sys.modules.setdefault("gapfill_llm_worker", types.ModuleType("gapfill_llm_worker"))
    return home.__dict__.setdefault(name, {})
