"""Classifier: held-out accuracy and its parts; rules: counts and distances against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from gapfill.llm import quality_model as qm
from gapfill.llm import quality_rules as qr

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in qm.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    pairs = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([s >= qm.ACCEPT for s in good]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    kept = qm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_normal_equations_match_one_task(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(qm.STATISTICS)))
    rows = [(list(map(float, v)), float(v[0] > 0)) for v in x]
    df = spark.createDataFrame(rows, "stats array<double>, label double")
    one, many = (qm.fit(df.repartition(n), n_features=32) for n in (1, 6))
    assert np.allclose(one.weights, many.weights) and np.all(np.diff(one.levels) >= 0)
    z = np.clip((x - one.mean) / one.scale, -qm.CLIP, qm.CLIP)
    phi = np.hstack([np.sqrt(2 / 32) * np.cos(z @ one.freq + one.phase), np.ones((500, 1))])
    penalty = qm.RIDGE * 500 * np.eye(33)
    penalty[-1, -1] = 0
    direct = np.linalg.solve(phi.T @ phi + penalty + 1e-9 * np.eye(33), phi.T @ np.array([y for _, y in rows]))
    assert np.allclose(one.weights, direct, atol=1e-6)


def test_pooling():
    x, y = qm.pool(np.arange(6.0), np.array([0.0, 1, 0, 1, 1, 0.5]), np.array([1.0, 1, 1, 1, 1, 2]))
    assert np.allclose(y, [0, 0.5, 0.75]) and np.allclose(x, [0, 1.5, (3 + 4 + 10) / 4])


def test_odd_rows_and_missing_labels(spark):
    rows = [(None, None), (1, ""), (2, "a"), (2, "a"), (3, "word " * 100_000), (4, "\x00퟿ 🙂")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as stats", "'s' as score", "5 as label")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in qm.classify(docs, none).collect()} == {1.0}
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1), (8, 0)], "doc_id long, quality int")
    got = qm.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert qm.keep_good(docs, labels).columns == docs.columns
    assert qm.classify(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert {round(r.score, 6) for r in qm.classify(docs, one).collect()} == {1.0}


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    twice = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)


def test_rules_counts(spark):
    odd = [(None, None, None), (9001, "", "en"), (9002, "a b a b a b", "en"), (9003, "x " * 60_000, None), (9003, "x\n\n x\nx", "xx"), (9004, "<&|é🙂>\x0b#", "de")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    docs = docs.selectExpr("*", "1 as n_words", "2 as w_", "3 as kept")
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.judge(docs).collect())
    assert got == sorted((r.doc_id or -1, *plain(r.text)) for r in docs.collect())
    assert qr.judge(docs.limit(0)).count() == 0


def test_rules_verdict(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = qr.judge(docs).join(labels, "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    long = [r for r in rows if not r.base_failed]
    assert np.mean([r.kept for r in long if r.quality]) > 0.98 and np.mean([r.kept for r in long if not r.quality]) < 0.5
    assert all(r.char_distance is None for r in rows if r.n_words < qr.MIN_WORDS)


def test_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    mid = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = math.sqrt(sum(x * math.log2(x / m) for s in (p, q) for x, m in zip(s, mid, strict=True) if x) / 2)
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    assert abs(df.select(qr._entropy_gap(F.col("p"), F.col("q"))).first()[0] - want) < 1e-12
