"""The Gram matrix against passes over the rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from gapfill.operators import embed


@pytest.mark.parametrize("rows", [0, 300])
def test_gram_is_formed_in_one_pass(spark, monkeypatch, rows):
    rng = np.random.default_rng(3)
    dense = rng.random((rows, 45)) * (rng.random((rows, 45)) < 0.2)
    df = spark.createDataFrame(
        [(i, Vectors.sparse(45, np.flatnonzero(x).tolist(), x[x > 0].tolist())) for i, x in enumerate(dense)], ["id", "vector"]
    ) if rows else spark.createDataFrame([], spark.createDataFrame([(0, Vectors.sparse(45, [], []))], ["id", "vector"]).schema)
    df = df.repartition(3).cache()
    monkeypatch.setattr(embed, "GRAM_ROWS", 16)
    np.testing.assert_allclose(embed.gram(df.select(*embed.sparse_parts("vector")), 45), dense.T @ dense, atol=1e-12)
    if not rows:
        return
    passes, times, whole = [], embed.gram_times, embed.gram
    monkeypatch.setattr(embed, "gram_times", lambda *a: passes.append("block") or times(*a))
    monkeypatch.setattr(embed, "gram", lambda *a: passes.append("whole") or whole(*a))
    once = embed.SvdEmbed(6).fit(df, 45)
    assert passes == ["whole"]
    monkeypatch.setattr(embed, "GRAM_DIM", 44)
    by_blocks = embed.SvdEmbed(6).fit(df, 45)
    assert passes == ["whole"] + ["block"] * 5
    np.testing.assert_allclose(once.components, by_blocks.components, atol=1e-9)
