import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapfill.operators.similar as similar
from gapfill.functions.text import is_blank
from gapfill.operators.chained import ChainedRidgeImputer, bayesian_ridge
from gapfill.operators.embed import SvdEmbed
from gapfill.operators.impute_basic import ConstantImputer, ModeImputer, fill_diff, most_frequent, propagate_fills, simple_imputer
from gapfill.operators.knn import IterativeTextImputer, KnnTextImputer, knn_donors
from gapfill.operators.similar import nearest_text, topk_similar
from gapfill.operators.tfidf import TfIdf
from gapfill.plans.versions import impute_grid, injection_grid


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id long, text string")


def test_mode(spark):
    assert most_frequent(texts(spark, ["b", "a", "b", "a", None, " "]), "text") == "a"
    assert most_frequent(texts(spark, ["b", "a"]), "text") == "a"
    assert most_frequent(texts(spark, ["b", "c", "c"]), "text") == "c"
    assert most_frequent(texts(spark, [None, ""]), "text") is None
    model = ModeImputer().fit(texts(spark, [None, "\t"]))
    assert model.value == "[MISSING_TEXT]"
    with pytest.raises(ValueError):
        simple_imputer("median")


def test_fit_on_one_table_fill_another(spark):
    model = ModeImputer().fit(texts(spark, ["x", "x", "y"]))
    out = model.transform(texts(spark, ["z", None, " "])).orderBy("row_id").collect()
    assert [(r["text"], r["was_filled"]) for r in out] == [("z", False), ("x", True), ("x", True)]


def test_propagate_and_diff(spark):
    primary = ConstantImputer().fit(None).transform(texts(spark, ["a", None, None, "d"]))
    target = texts(spark, ["a", "b", None, "d"])
    out = propagate_fills(target, primary, "row_id").orderBy("row_id").collect()
    assert [r["text"] for r in out] == ["a", "b", "[MISSING_TEXT]", "d"]
    assert [r["row_id"] for r in fill_diff(target, propagate_fills(target, primary, "row_id"), "row_id").collect()] == [2]


def test_grid_keeps_observed_texts(spark):
    base = texts(spark, [f"text {i}" for i in range(60)])
    versions = injection_grid(base, "row_id")
    out = impute_grid(versions, {"mode": ModeImputer(), "const": ConstantImputer()}, "row_id")
    assert out.count() == 2 * 6 * 60
    assert out.filter(is_blank("text")).count() == 0
    assert out.filter(~F.col("text_is_missing") & (F.col("text") != F.col("text_original"))).count() == 0
    with pytest.raises(ValueError):
        impute_grid(versions, {"const": ConstantImputer()}, "row_id", primary="50")
    assert impute_grid(versions, {"const": ConstantImputer()}, "row_id", limit=5).count() == 6 * 5


def contexts(spark, n=60):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        text = None if i % 4 == 0 else " ".join(rng.choice(["red", "blue", "green", "gold", "grey"], 4))
        score = float(rng.integers(1, 6)) if i % 7 else None
        rows.append((i, text, str(rng.choice(["a", "b", "c"])), score))
    return rows, spark.createDataFrame(rows, "row_id long, text string, grp string, score double")


def brute_donors(rows, k=5):
    out = {}
    for q in (r for r in rows if r[1] is None):
        found = []
        for d in (r for r in rows if r[1] is not None):
            both = q[3] is not None and d[3] is not None
            square = (2.0 if q[2] != d[2] else 0.0) + ((q[3] - d[3]) ** 2 if both else 0.0)
            found.append((round(float(np.sqrt(square * 4 / (4 if both else 3))), 9), d[0]))
        found = sorted(found)[:k]
        zero = found[0][0] == 0
        out[q[0]] = {i: ((1.0 if d == 0 else 0.0) if zero else 1 / d) for d, i in found}
    return out


@pytest.mark.parametrize("limit", [similar.BROADCAST_BYTES, 0])
def test_knn_donors_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(similar, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 7)
    rows, df = contexts(spark)
    got = {}
    for r in knn_donors(df, "row_id", "text", ["grp", "score"]).collect():
        got.setdefault(r["row_id"], {})[r["donor"]] = r["weight"]
    want = brute_donors(rows)
    assert {q: set(d) for q, d in got.items()} == {q: set(d) for q, d in want.items()}
    for q in want:
        assert got[q] == pytest.approx(want[q], abs=1e-6)


def test_knn_impute_against_brute_force(spark):
    rows, df = contexts(spark)
    observed = df.filter("text is not null")
    model = TfIdf("text", 3000).fit(observed)
    dense = {r["row_id"]: np.array(r["vector"].toArray()) for r in model.transform(observed).collect()}
    ids = sorted(dense)
    out = {r["row_id"]: r["text"] for r in KnnTextImputer("row_id", "text", ["grp", "score"]).fit(df).transform(df).collect()}
    by_id = {r[0]: r[1] for r in rows}
    for q, donors in brute_donors(rows).items():
        mean = sum(w * dense[i] for i, w in donors.items()) / sum(donors.values())
        scores = [round(float(mean @ dense[i] / np.linalg.norm(mean)), 9) for i in ids]
        assert out[q] == by_id[ids[int(np.argmax(scores))]]
    assert all(out[r[0]] == r[1] for r in rows if r[1] is not None)


def test_iterative_text(spark):
    rows, df = contexts(spark)
    out = {r["row_id"]: r["text"] for r in IterativeTextImputer("row_id", "text", ["grp", "score"], svd=3).fit(df).transform(df).collect()}
    seen = {r[1] for r in rows if r[1] is not None}
    assert len(out) == len(rows) and set(out.values()) <= seen


def test_nearest_without_corpus(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, embedding array<double>")
    empty = spark.createDataFrame([], "row_id long, embedding array<double>, text string")
    assert nearest_text(q, empty, "q", "row_id").first()["text"] == "[MISSING_TEXT]"


def test_topk_ties_go_to_the_smallest_id(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    c = spark.createDataFrame([(9, [2.0, 0.0]), (3, [1.0, 0.0]), (5, [0.0, 1.0])], "id long, vec array<double>")
    assert [r["match"] for r in topk_similar(q, c, 2).orderBy("rank").collect()] == [3, 9]


def _brute_topk(q, c, k, score):
    return {(i, j, round(round(s, 9), 6) + 0.0) for i, x in q for s, j in sorted(((score(x, y), j) for j, y in c), key=lambda e: (-round(e[0], 9), e[1]))[:k]}


def _cosine(x, y):
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(np.dot(x, y) / n) if n else 0.0


def _found(df):
    return {(r["query"], r["match"], round(r["score"], 6) + 0.0) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 5])
def test_pruned_search_against_brute_force(spark, monkeypatch, block):
    """Clustered vectors, copies of one, zeros, and queries far from all: the pruned form gives the k best, ties by id."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    monkeypatch.setattr(similar, "CLUSTER_ROWS", 8)
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((12, 6)) * 3
    c = [(i, centres[i % 12] + rng.standard_normal(6) * 0.2) for i in range(150)]
    c += [(200 + i, centres[0]) for i in range(40)] + [(300, np.zeros(6)), (301, -centres[1])]
    q = [(i, centres[i % 12] * 2 + rng.standard_normal(6)) for i in range(30)] + [(50, np.zeros(6)), (51, centres[0])]

    def frame(rows):
        return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "id long, vec array<double>")

    for k in (1, 4, 1000):
        assert _found(topk_similar(frame(q), frame(c), k, pruned=True)) == _brute_topk(q, c, k, _cosine)
    assert topk_similar(frame(q), frame(c[:0]), 3, pruned=True).count() == 0


def test_dense_rows_are_sent_to_groups_not_to_clusters(spark, monkeypatch):
    """Vectors without clusters: bounds leave nothing out, yet a query is sent once per group, of which there are few."""
    monkeypatch.setattr(similar, "CLUSTER_ROWS", 2)
    monkeypatch.setattr(similar, "GRID_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(12)) for i in range(200)] + [(1000 - i, np.ones(12)) for i in range(60)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "id long, vec array<double>")
    monkeypatch.setattr(similar, "_pruned", None)
    assert _found(topk_similar(df, df, 4, pruned=True)) == _brute_topk(rows, rows, 4, _cosine)
    monkeypatch.setattr(similar, "GRID_BYTES", 8 * 12 * 30)  # more groups than cores need
    monkeypatch.setattr(similar, "TILE_ROWS", 3)
    assert _found(topk_similar(df, df, 4, pruned=True)) == _brute_topk(rows, rows, 4, _cosine)


def test_pruned_search_of_sparse_rows(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    rows = [(i, np.where(rng.random(20) < 0.2, rng.random(20), 0)) for i in range(120)] + [(500, np.zeros(20))]

    def frame(rows):
        parts = [(i, [int(j) for j in np.flatnonzero(x)], [float(v) for v in x[x != 0]]) for i, x in rows]
        return spark.createDataFrame(parts, "id long, _i array<int>, _v array<double>")

    q = [(i + 1000, x) for i, x in rows[::5]] + [(2000, np.zeros(20))]
    for bytes_ in (similar.BROADCAST_BYTES, 0):  # a cluster per term, and one for all
        monkeypatch.setattr(similar, "BROADCAST_BYTES", bytes_)
        assert _found(topk_similar(frame(q), frame(rows), 3, dim=20, pruned=True)) == _brute_topk(q, rows, 3, _cosine)


def test_bounds_leave_most_clusters_out():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 16)) * 5
    rows = np.repeat(centres, 30, axis=0) + rng.standard_normal((1200, 16)) * 0.1
    for metric in ("cosine", "nan_distance"):
        made = similar.Clusters(metric, None, similar._centres(rows, metric), np.zeros(0))
        best, away = made.assign(rows)
        radius = np.zeros(len(made.centres))
        np.maximum.at(radius, best, away)
        bounds = similar.Clusters(metric, None, made.centres, radius).bounds(rows[:50])
        scores = similar._METRICS[metric](rows[:50], rows)
        assert all((scores[:, best == c] <= bounds[:, [c]] + 1e-9).all() for c in range(len(radius)))
        tenth = -np.sort(-scores, axis=1)[:, 9]
        assert (bounds >= tenth[:, None]).mean() < 0.3


def test_svd_spans_the_leading_subspace(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    p = np.array([1 / (i + 1) for i in range(40)])
    df = spark.createDataFrame([(i, " ".join(rng.choice(words, 12, p=p / p.sum()))) for i in range(80)], "k long, text string")
    model = TfIdf("text", 40, ngram=(1, 1)).fit(df)
    vectors = model.transform(df)
    svd = SvdEmbed(4, rounds=12).fit(vectors, model.dim)
    a = np.array([r["vector"].toArray() for r in vectors.orderBy("k").collect()])
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    got = np.array([r["embedding"] for r in svd.transform(vectors).orderBy("k").collect()])
    np.testing.assert_allclose(np.linalg.norm(got, axis=0), s[:4], rtol=1e-3)
    np.testing.assert_allclose(np.abs(np.sum(svd.components * vt[:4].T, axis=0)), 1, atol=1e-2)
    assert SvdEmbed(64).fit(vectors, model.dim).width == model.dim


def sequential_ridge(x, rounds):
    """Row-level chained regression, the way it is usually written."""
    missing = np.isnan(x)
    filled = np.where(missing, np.nanmean(x, axis=0), x)
    order = [j for j in np.argsort(missing.sum(axis=0), kind="stable") if missing[:, j].any()]
    for _ in range(rounds):
        for j in order:
            rest = np.delete(np.arange(x.shape[1]), j)
            seen = ~missing[:, j]
            a, y = filled[seen][:, rest], x[seen, j]
            ac, yc = a - a.mean(axis=0), y - y.mean()
            coef = bayesian_ridge(ac.T @ ac, ac.T @ yc, yc @ yc, len(y))
            filled[missing[:, j], j] = (filled[missing[:, j]][:, rest] - a.mean(axis=0)) @ coef + y.mean()
    return filled


def test_chained_ridge_against_row_level_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 5
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double").repartition(5)
    out = ChainedRidgeImputer(["a", "b", "c", "d"]).fit(df).transform(df).orderBy("k").toPandas()
    got = out[[f"{c}_filled" for c in "abcd"]].to_numpy()
    np.testing.assert_allclose(got, sequential_ridge(x, 10), rtol=1e-5, atol=1e-6)


def test_iterative_query_runs_at_the_default_size(monkeypatch):
    from checks import features

    made = []
    monkeypatch.setattr(features, "fixture", lambda *_: None)
    monkeypatch.setattr(IterativeTextImputer, "fit", lambda self, df: made.append(self.svd) or self)
    monkeypatch.setattr(IterativeTextImputer, "transform", lambda self, df: self, raising=False)
    monkeypatch.setattr(IterativeTextImputer, "select", lambda self, *_: None, raising=False)
    features.iterative_text_impute(None, "")
    assert made == [256]


def test_grid_versions_are_not_written(spark):
    """The versions are a dozen copies of the texts; fills read them as they are made."""
    from checks.impute import impute_grid_of
    from gapfill import session

    before = len(session._WRITTEN)
    assert impute_grid_of(spark, "/root/testdata/sf0.001").count() == 12 * 200
    assert not [p for p in session._WRITTEN[before:] if "/versions-" in p]


def test_vocabulary_without_rare_terms(spark, monkeypatch):
    """Buckets of rare terms are left out before the shuffle; the most frequent terms, ties too, are the same."""
    import gapfill.operators.tfidf as tfidf

    rng = np.random.default_rng(4)
    p = 1 / np.arange(1, 301)
    rows = [(i, " ".join(f"w{j}" for j in rng.choice(300, rng.integers(0, 60), p=p / p.sum())), int(rng.integers(1, 4))) for i in range(300)]
    df = spark.createDataFrame([*rows, (1000, None, 1)], "k long, text string, n long")
    counted = []
    true = tfidf.term_sums
    monkeypatch.setattr(tfidf, "term_sums", lambda *args: counted.append(true(*args)) or counted[-1])
    for most, args in ((50, {}), (50, {"min_df": 20, "weight": "n"}), (40, {"ngram": (2, 3)}), (100_000, {"min_df": 2})):
        found = []
        for limit in (float("inf"), 0):
            counted.clear()
            monkeypatch.setattr(tfidf, "PRUNE_BYTES", limit)
            found.append(([tuple(r) for r in tfidf.vocabulary(df, "text", most, **args).collect()], counted[0].count()))
        assert found[0][0] == found[1][0] and len(found[0][0]) == (most if most < 1000 else len(found[0][0]))
        if most < 1000:
            assert found[1][1] < found[0][1] / 2


@pytest.mark.parametrize("metric", ["nan_distance", "cosine"])
def test_scores_take_bounded_memory(metric):
    """A block of queries and one of the corpus are scored in pieces: the memory does not grow with the queries."""
    rng = np.random.default_rng(2)
    corpus, ids = np.round(rng.random((2048, 6)), 1), rng.permutation(2048)
    corpus[rng.random(corpus.shape) < 0.1] = np.nan

    def peak(n):
        asked = np.random.default_rng(3).random((n, 6))
        tracemalloc.start()
        found = similar._best(np.arange(n), asked, ids, corpus, 3, metric)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, top

    few, _ = peak(500)
    many, top = peak(6000)
    assert many[many["query"] < 500].reset_index(drop=True).equals(few.reset_index(drop=True))
    assert top < 120 << 20
