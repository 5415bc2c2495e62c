"""Truncated SVD embedding of sparse vectors.

Subspace iteration: a small dense block is multiplied by the Gram matrix round by round. Up to ``GRAM_DIM`` terms the Gram
matrix is formed in one pass over the data, and the rounds read it alone. For larger vocabularies it is never formed: a
round is a pass that multiplies the block. A pass has one task per core, however many files the vectors lie in, so that few
matrices leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.operators.blocks import BLOCK_SCHEMA, emit_blocks, sum_blocks
from gapfill.session import materialize

BATCH_ROWS = 256  # rows densified at a time inside a task
#: Terms up to which the Gram matrix is formed (128 MB), and rows that are multiplied at a time for it.
GRAM_DIM = 4096
GRAM_ROWS = 1024


def _dense_rows(indices: pd.Series, values: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(indices), dim))
    for r, (i, v) in enumerate(zip(indices, values)):
        out[r, i] = v
    return out


def sparse_parts(vector: str) -> list[Column]:
    """Indices and values of a sparse vector column."""
    vec = F.unwrap_udt(vector)
    return [vec["indices"].alias("_i"), vec["values"].alias("_v")]


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """``A^T A B`` for the sparse rows ``A`` (columns ``_i``, ``_v``) and a small block ``B``."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(block)  # dim x (k + oversampling), bounded by the vocabulary size
    dim, width = block.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        total = np.zeros((dim, width))
        for pdf in batches:
            for start in range(0, len(pdf), BATCH_ROWS):
                part = pdf.iloc[start : start + BATCH_ROWS]
                a = _dense_rows(part["_i"], part["_v"], dim)
                used = np.flatnonzero(a.any(axis=0))
                a = a[:, used]
                total[used] += a.T @ (a @ b[used])
        yield emit_blocks({b"": total})

    parts = sc.defaultParallelism
    products = rows.coalesce(parts).mapInPandas(partial, BLOCK_SCHEMA)
    return sum_blocks(products, block.shape, parts).get(b"", np.zeros(block.shape))


def gram(rows: DataFrame, dim: int) -> np.ndarray:
    """``A^T A`` for the sparse rows ``A`` (columns ``_i``, ``_v``), formed in one pass.

    Tasks send their sums in strips, which are added up strip by strip before they reach the driver.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism
    strip = -(-dim // parts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros((dim, dim)), np.empty((dim, dim))
        for batch in batches:
            index, value = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))])
            for at in range(0, batch.num_rows, GRAM_ROWS):
                own = starts[at : at + GRAM_ROWS + 1]
                some = slice(own[0], own[-1])
                a = np.zeros((len(own) - 1, dim))
                a[np.repeat(np.arange(len(a)), np.diff(own)), index[some]] = value[some]
                total += np.matmul(a.T, a, out=product)
        del product
        for at in range(0, dim, strip):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + strip].tobytes()], pa.binary())], ["at", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(part.as_buffer())
                sums[at] = sums[at] + own if at in sums else own.copy()
        for at, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([own.tobytes()], pa.binary())], ["at", "part"])

    schema = "at long, part binary"
    strips = rows.coalesce(parts).mapInArrow(partial, schema).repartition(parts, "at").mapInArrow(add, schema)
    out = np.zeros((dim, dim))
    for r in strips.collect():  # the strips of one matrix, each once
        own = np.frombuffer(r["part"]).reshape(-1, dim)
        out[r["at"] : r["at"] + len(own)] = own
    return out


@dataclass(frozen=True)
class SvdEmbed:
    """Right singular subspace of the vectors; pass-through when there are no more than k terms."""

    k: int = 256
    vector: str = "vector"
    seed: int = 42
    rounds: int = 4
    oversampling: int = 10

    def fit(self, df: DataFrame, dim: int, stored: bool = False) -> SvdModel:
        """``stored`` says that ``df`` is a written table, so that its vectors need not be written again."""
        if dim <= 1 or dim <= self.k:
            return SvdModel(self.vector, dim, None)
        k = max(1, min(self.k, dim - 1))
        width = min(k + self.oversampling, dim)
        rows = df.filter(F.col(self.vector).isNotNull()).select(*sparse_parts(self.vector))
        rows = rows if stored else materialize(rows, "svd-rows")
        whole = gram(rows, dim) if dim <= GRAM_DIM else None

        def times(block: np.ndarray) -> np.ndarray:
            return gram_times(rows, block) if whole is None else whole @ block

        rng = np.random.default_rng(self.seed)
        basis, _ = np.linalg.qr(rng.standard_normal((dim, width)))
        for _ in range(self.rounds):
            basis, _ = np.linalg.qr(times(basis))
        small = basis.T @ times(basis)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:k]
        components = basis @ vectors[:, top]
        sign = np.sign(components[np.abs(components).argmax(axis=0), np.arange(k)])
        return SvdModel(self.vector, dim, components * sign)


@dataclass(frozen=True)
class SvdModel:
    vector: str
    dim: int
    components: np.ndarray | None

    @property
    def width(self) -> int:
        return self.dim if self.components is None else self.components.shape[1]

    def transform(self, df: DataFrame, out: str = "embedding") -> DataFrame:
        """``df`` with a dense embedding; rows without a vector get null."""
        if self.components is None:
            return df.withColumn(out, F.when(F.col(self.vector).isNotNull(), vector_to_array(self.vector)))
        shared = df.sparkSession.sparkContext.broadcast(self.components)
        dim = self.dim

        @F.pandas_udf("array<double>")
        def project(indices: pd.Series, values: pd.Series) -> pd.Series:
            out_rows: list = []
            for start in range(0, len(indices), BATCH_ROWS):
                i, v = indices.iloc[start : start + BATCH_ROWS], values.iloc[start : start + BATCH_ROWS]
                seen = i.notna().to_numpy()
                dense = np.zeros((len(i), dim))
                for r in np.flatnonzero(seen):
                    dense[r, i.iloc[r]] = v.iloc[r]
                emb = dense @ shared.value
                out_rows += [emb[r] if seen[r] else None for r in range(len(i))]
            return pd.Series(out_rows)

        vec = F.unwrap_udt(self.vector)
        return df.withColumn(out, project(vec["indices"], vec["values"]))
