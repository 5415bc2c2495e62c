"""Near-duplicates against all pairs, the sampler against the similarity, and groups that are not alike."""

import random
from collections import defaultdict

import numpy as np
import pytest

from gapfill.llm import near_dedup as nd
from gapfill.llm.components import components


def text(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def edit(rng, t, k):
    words = t.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = f"e{rng.random()}"
    return " ".join(words)


def brute(rows):
    norm = {r: " ".join((r[1] or "").lower().split()) for r in set(rows)}
    n = sum(bool(norm[r]) for r in rows)
    df = defaultdict(int)
    for r in rows:
        if norm[r]:
            for h in nd.shingles(norm[r])[0]:
                df[int(h)] += 1
    heavy = sorted(h for h, c in df.items() if n >= 10 and c >= nd.COMMON_SHARE * n)
    w = nd.Weights(np.array(heavy, np.uint64), np.array([nd.idf(df[h], n) for h in heavy]))
    group = {r: r for r in norm}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    items = [r for r in norm if norm[r]]
    bags = {r: w.weigh(norm[r]) for r in items}
    for i, a in enumerate(items):
        for b in items[:i]:
            if norm[a] == norm[b] or nd.weighted_jaccard(bags[a], bags[b]) >= nd.SIMILARITY:
                group[find(a)] = find(b)
    out = defaultdict(set)
    for r in norm:
        out[find(r)].add(r[0])
    return {frozenset(v) for v in out.values()}


def got(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["class"] if r["class"] is not None else ("alone", r.doc_id)].add(r.doc_id)
        assert r.class_id is None or r.class_id <= (r.doc_id if r.doc_id is not None else r.class_id)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.choice([3, 6, 40, 120, 300]))) for i in range(60)]
    for i in range(60):
        t = rows[rng.randint(0, 59)][1]
        rows.append((100 + i, edit(rng, t, min(len(t.split()), rng.choice([0, 1, 2, 5])))))
    boiler = text(rng, 30)
    rows += [(300 + i, boiler + " " + text(rng, rng.choice([5, 30, 90]))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(nd.classes(docs)) == brute(rows)


def test_one_bucket_of_many_texts(spark):
    """A group whose members go apart bit by bit: some near its centre, others near nothing."""
    rng = random.Random(9)
    base = text(rng, 150, 10_000)
    rows = [(i, edit(rng, base, rng.choice([0, 1, 2, 3, 8, 20]))) for i in range(120)]
    rows += [(500 + i, text(rng, 80)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(nd.classes(docs)) == brute(rows)


def test_samples_collide_with_the_similarity():
    rng = random.Random(4)
    a = text(rng, 300, 5_000)
    b = edit(rng, a, 12) + " " + " ".join(a.split()[:40])
    none = nd.Weights(np.array([], np.uint64), np.array([]))
    s = nd.Sampler(bands=100, rows=20)
    x, y = none.weigh(a), none.weigh(b)
    share = np.mean(s.samples(*x) == s.samples(*y))
    assert abs(share - nd.weighted_jaccard(x, y)) < 0.04


def test_common_shingles_are_counted_exactly(spark):
    rng = random.Random(3)
    line = text(rng, 12)
    rows = [(f"{line} {text(rng, 30)}" if i % 4 == 0 else text(rng, 30),) for i in range(200)]
    docs = spark.createDataFrame(rows, "norm string")
    one, many = (nd.common_shingles(docs.repartition(n)) for n in (1, 9))
    assert len(one.common) == 8 and list(one.common) == list(many.common) and list(one.idf) == list(many.idf)
    assert np.allclose(one.idf, nd.idf(50, 200))


def test_every_shingle_has_its_idf(spark, monkeypatch):
    """What 2, 5 and 20 of 80 texts share weighs less and less, whichever slices and ranges of hashes it is dealt to."""
    rng = random.Random(12)
    group = text(rng, 100, 10_000).split()
    rows = [(i, " ".join([*group[: 10 + 18 * i], "other", *group[11 + 18 * i :]])) for i in range(5)]
    two, twenty = text(rng, 12, 10_000), text(rng, 12, 10_000)
    rows += [(100 + i, f"{text(rng, 60, 10_000)} {two if i < 2 else twenty if i < 22 else ''}") for i in range(75)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(nd, "SLICE_CHARS", 2_000)
    monkeypatch.setattr(nd, "PART_CHARS", 5_000)
    found = nd.common_shingles(docs.selectExpr("trim(text) as norm"), 2 / 80)
    of = dict(zip(found.common.tolist(), found.idf.tolist(), strict=True))
    for line, df in ((two, 2), (twenty, 20)):
        assert np.allclose([of[int(h)] for h in nd.shingles(line)[0]], nd.idf(df, 80))
    assert 1 > nd.idf(2, 80) > nd.idf(5, 80) > nd.idf(20, 80) > nd.idf(80, 80) >= nd.LEAST_IDF
    # One word of a hundred differs: 0.81 without weights, but under 0.8 as five texts have what they share.
    none = nd.Weights(np.array([], np.uint64), np.array([]))
    assert nd.weighted_jaccard(none.weigh(rows[0][1]), none.weigh(rows[1][1])) > nd.SIMILARITY
    assert got(nd.classes(docs)) == brute(rows) == {frozenset({i}) for i, _ in rows}


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (4, "one  TWO"), (None, "one two"), (5, "x " * 100_000), (6, "X " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as bucket", "'n' as norm")
    sizes = sorted((r.doc_id or 0, r.class_id, r.class_size) for r in nd.classes(docs).collect() if r.class_id)
    assert sizes == [(0, 3, 4), (1, 1, 1), (2, 2, 1), (3, 3, 4), (4, 3, 4), (4, 3, 4), (5, 5, 2), (6, 5, 2)]
    kept = nd.keep_one(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5] and kept.columns == docs.columns
    assert nd.classes(docs.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "a b c", "p"), (1, "a b c", "q")], "doc_id long, text string, kept_id string")
    assert nd.keep_one(again).count() == 1


def test_components(spark):
    rng = random.Random(8)
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 60)] + [(f"h{rng.randint(0, 9)}", "h5") for _ in range(30)] + [("z", "z")]
    group = {r.node: r["class"] for r in components(spark.createDataFrame(links, "x string, y string")).collect()}
    assert {group[f"{i:03}"] for i in range(61)} == {"000"} and len({v for k, v in group.items() if k[0] == "h"}) == 1
