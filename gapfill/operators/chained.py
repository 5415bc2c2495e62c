"""Chained ridge imputation of numeric columns.

Every fill is a linear function of the observed values of its row, so the whole chain of
regressions needs nothing but the second moments of the observed values per missing pattern.
They are collected in one pass over the data; all rounds then run on these small matrices, and
one more pass writes the fills. There is no per-round job and no growing lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.functions.scores import number
from gapfill.operators.blocks import BLOCK_SCHEMA, emit_blocks, sum_blocks

# (X'X, X'y, y'y, n) of centred data -> coefficients
Solver = Callable[[np.ndarray, np.ndarray, float, float], np.ndarray]


def bayesian_ridge(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float) -> np.ndarray:
    """Ridge coefficients whose noise and weight precision maximise the evidence (MacKay 1992)."""
    rounds, tol, prior = 300, 1e-3, 1e-6
    values, basis = np.linalg.eigh(xtx)
    values = np.maximum(values, 0.0)
    projected = basis.T @ xty
    noise = 1.0 / (yty / n + np.finfo(float).eps)
    precision = 1.0

    def fit() -> np.ndarray:
        return basis @ (projected / (values + precision / noise))

    previous = None
    for _ in range(rounds):
        coef = fit()
        error = max(yty - 2 * coef @ xty + coef @ xtx @ coef, 0.0)
        effective = np.sum(noise * values / (precision + noise * values))
        precision = (effective + 2 * prior) / (coef @ coef + 2 * prior)
        noise = (n - effective + 2 * prior) / (error + 2 * prior)
        if previous is not None and np.abs(previous - coef).sum() < tol:
            break
        previous = coef
    return fit()


def _fill_map(missing: np.ndarray, steps: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    """Matrix taking ``[1, observed values]`` to the filled row, for one missing pattern."""
    fill = np.diag(np.concatenate([[1.0], (~missing).astype(float)]))
    for j, coef in steps:
        if missing[j]:
            fill[j + 1] = coef @ fill
    return fill


@dataclass(frozen=True)
class ChainedRidgeImputer:
    """Round-robin regression of every incomplete column on all others, means to start with."""

    cols: Sequence[str]
    max_iter: int = 10
    solver: Solver = bayesian_ridge
    out: str = "{}_filled"

    def fit(self, df: DataFrame) -> ChainedRidgeModel:
        cols = list(self.cols)
        stats = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        means = np.array([stats[i] if stats[i] is not None else 0.0 for i in range(len(cols))])
        moments = pattern_moments(df, cols, means)
        return ChainedRidgeModel(self, means, tuple(chain_steps(moments, len(cols), self.max_iter, self.solver)))


def pattern_moments(df: DataFrame, cols: Sequence[str], means: np.ndarray) -> dict[bytes, np.ndarray]:
    """``sum z z'`` per missing pattern, ``z = [1, value - mean]`` with zeros where missing."""
    width = len(cols) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[bytes, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = pdf.to_numpy(dtype=float) - means
            missing = np.isnan(x)
            z = np.hstack([np.ones((len(x), 1)), np.where(missing, 0.0, x)])
            patterns, which = np.unique(missing, axis=0, return_inverse=True)
            for i, pattern in enumerate(patterns):
                part = z[which.ravel() == i]
                key = pattern.astype(np.uint8).tobytes()
                totals[key] = totals.get(key, 0.0) + part.T @ part
        yield emit_blocks(totals)

    rows = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    parts = df.sparkSession.sparkContext.defaultParallelism
    return sum_blocks(rows.coalesce(parts).mapInPandas(partial, BLOCK_SCHEMA), (width, width), parts)


def chain_steps(
    moments: dict[bytes, np.ndarray], p: int, max_iter: int, solver: Solver
) -> list[tuple[int, np.ndarray]]:
    """The regressions in the order they apply, as coefficients on ``[1, filled row]``."""
    masks = {key: np.frombuffer(key, dtype=np.uint8).astype(bool) for key in moments}
    fills = {key: _fill_map(mask, []) for key, mask in masks.items()}
    absent = np.array([sum(m[0, 0] for key, m in moments.items() if masks[key][j]) for j in range(p)])
    order = [j for j in np.argsort(absent, kind="stable") if absent[j] > 0]
    steps: list[tuple[int, np.ndarray]] = []
    solved: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for _ in range(max_iter):
        moved = False
        for j in order:
            gram = np.zeros((p + 1, p + 1))
            for key, m in moments.items():
                if not masks[key][j]:
                    gram += fills[key] @ m @ fills[key].T
            if gram[0, 0] == 0:
                continue
            if j in solved and np.array_equal(solved[j][0], gram):
                coef = solved[j][1]
            else:
                coef = _regress(gram, j, solver)
                solved[j] = (gram, coef)
            steps.append((int(j), coef))
            for key, mask in masks.items():
                if mask[j]:
                    row = coef @ fills[key]
                    moved = moved or not np.allclose(row, fills[key][j + 1], rtol=1e-12, atol=1e-15)
                    fills[key][j + 1] = row
        if not moved:
            break
    return steps


def _regress(gram: np.ndarray, j: int, solver: Solver) -> np.ndarray:
    """Regression of column j on the other columns and an intercept, from uncentred moments."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    others = np.delete(np.arange(len(mean)), j)
    out = np.zeros(len(mean) + 1)
    if len(others):
        weights = solver(centred[np.ix_(others, others)], centred[others, j], max(centred[j, j], 0.0), n)
        out[others + 1] = weights
        out[0] = mean[j] - weights @ mean[others]
    else:
        out[0] = mean[j]
    return out


@dataclass(frozen=True)
class ChainedRidgeModel:
    config: ChainedRidgeImputer
    means: np.ndarray
    steps: tuple = field(repr=False)

    def filled_array(self) -> Column:
        """All imputed columns of a row as one array, in the order of ``cols``."""
        means, steps = self.means, self.steps

        @F.pandas_udf("array<double>")
        def fill(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(dtype=float) for v in values]) - means
            missing = np.isnan(x)
            z = np.hstack([np.ones((len(x), 1)), np.where(missing, 0.0, x)])
            out = z[:, 1:].copy()
            patterns, which = np.unique(missing, axis=0, return_inverse=True)
            for i, pattern in enumerate(patterns):
                if pattern.any():
                    rows = which.ravel() == i
                    out[rows] = (z[rows] @ _fill_map(pattern, steps).T)[:, 1:]
            return pd.Series(list(out + means))

        return fill(*[number(c) for c in self.config.cols])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with one filled double column per imputed column."""
        named = {
            self.config.out.format(c): F.coalesce(number(c), F.get(F.col("_filled"), F.lit(i)))
            for i, c in enumerate(self.config.cols)
        }
        return df.withColumn("_filled", self.filled_array()).withColumns(named).drop("_filled")
