"""Whitening: the spectral split against a library solver, the query's columns against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from gapfill.llm import queries, whitening


def _odd_matrices():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    yield np.cov(rng.standard_normal((64, 500)))
    yield q @ np.diag([5.0] * 8 + [2.0] * 8 + [0.0] * 8) @ q.T  # ties and no full rank
    yield q @ np.diag(10.0 ** -np.arange(24)) @ q.T  # a wide range
    yield np.diag(np.arange(6.0))
    yield np.eye(5)
    yield np.zeros((4, 4))
    yield np.array([[3.0]])
    yield np.array([[2.0, 1.0], [1.0, 2.0]])
    yield np.ones((7, 7))


@pytest.mark.parametrize("a", list(_odd_matrices()), ids=str)
def test_components(a):
    values, vectors = whitening.components(a)
    scale = max(np.linalg.norm(a), 1e-300)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert np.abs(values - want).max() <= 1e-13 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * scale * len(a)


def test_polar_factor():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar_factor(a)
    assert np.abs(u @ u.T - np.eye(30)).max() < 1e-13
    h = u.T @ a
    assert np.abs(h - h.T).max() < 1e-12 and np.linalg.eigvalsh((h + h.T) / 2).min() > 0
    assert whitening.polar_factor(np.diag([1.0, 0.0])) is None


def _plain(vectors):
    x = np.floor(64 * np.asarray(vectors, dtype=float)).astype(object) + 1_000_000
    x = np.array([[int(v) for v in row] for row in x], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = n * x - sums
    v = (centred.astype(float) / n).T @ (centred.astype(float) / n) / n
    values, basis = np.linalg.eigh(v)
    return n, (centred**2).sum(axis=1), centred.astype(float) / n, values[::-1], basis[:, ::-1], np.trace(v)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_whitening(spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    n, deviation, centred, values, basis, trace = _plain(rows["embedding"].tolist())
    assert len(got) == 32 * n and set(got["n"]) == {n}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    want = centred @ basis[:, :32] / np.sqrt(values[:32])
    want *= np.sign((wide * want).sum(axis=0))
    assert np.abs(wide - want).max() < 1e-8
    assert got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[rows["vec_id"]].tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], values[:32] / trace, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def _frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding {kind}, component string")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (None, [2.0, -3.0]), (3, [0.0, 4.25]), (3, [0.0, 4.25])]
    bad = [(4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, []), (9, [1.0]), (10, [1.0, -inf])]
    got = whitening.whiten(_frame(spark, good + bad)).toPandas()
    assert len(got) == 8 and set(got["n"]) == {4} and sorted(got["component"]) == [1] * 4 + [2] * 4
    assert got["vec_id"].isna().sum() == 2 and (got["vec_id"] == 3).sum() == 4
    one = whitening.whiten(_frame(spark, [(1, [1.0, 2.0])])).toPandas()
    assert len(one) == 2 and one["whitened"].isna().all() and (one["explained"] == 0).all() and (one["deviation"] == 0).all()
    for rows in ([], bad[:2], [(8, [])]):
        none = whitening.whiten(_frame(spark, rows))
        assert none.columns == list(got.columns) and none.count() == 0


def test_large_entries(spark):
    """Sums and deviations stay exact beyond what doubles hold; what exceeds a long is null."""
    rows = [(1, [2.0**44, 1.0]), (2, [2.0**44 + 64, 0.0]), (3, [2.0**44, 5.0])]
    got = whitening.whiten(_frame(spark, rows, "array<double>")).toPandas().drop_duplicates("vec_id").set_index("vec_id")
    _, want, *_ = _plain([v for _, v in rows])
    assert [int(got["deviation"][i]) for i in (1, 2, 3)] == [int(v) for v in want]
    huge = whitening.whiten(_frame(spark, [(1, [2.0**50]), (2, [0.0]), (3, [2.0**57])], "array<double>")).toPandas()
    assert sorted(huge["vec_id"]) == [1, 2] and huge["deviation"].isna().all() and np.allclose(huge["whitened"].abs(), 1)
    assert isinstance(huge, pd.DataFrame)
