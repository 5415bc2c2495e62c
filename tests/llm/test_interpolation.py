"""Deleted interpolation against plain counting with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gapfill.llm import interpolation as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), "\n"]


def _crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


def _counts(texts, order):
    of = [Counter() for _ in range(order)]
    for t in texts:
        words = ["\t"] * (order - 1) + _tokens(t)
        for i in range(order - 1, len(words)):
            for n in range(1, order + 1):
                of[n - 1][tuple(words[i - n + 1 : i + 1])] += 1
    return of, sum(of[0].values()), len(texts)


def _context(counts, gram, order):
    of, total, texts = counts
    if len(gram) == 1:
        return total
    before = gram[:-1]
    return texts if before[-1] == "\t" else of[len(before) - 1][before]


def _events(counts, text, order):
    of, total, _ = counts
    words = ["\t"] * (order - 1) + _tokens(text)
    for i in range(order - 1, len(words)):
        p, bucket = [1 / (len(of[0]) + 1)], 0
        for n in range(1, order + 1):
            gram = tuple(words[i - n + 1 : i + 1])
            seen = _context(counts, gram, order)
            p.append(of[n - 1][gram] / seen if seen else 0.0)
            if seen:
                bucket = 64 * n + int(math.log2(seen))
        yield bucket, p


def _learn(events, order):
    weights = {b: lm.even(b, order) for b, _ in events}
    last = None
    for _ in range(lm.MAX_ROUNDS if events else 0):
        sums, n, gain = defaultdict(lambda: [0.0] * (order + 1)), Counter(), 0.0
        for b, p in events:
            parts = [x * y for x, y in zip(p, weights[b])]
            whole = sum(parts)
            gain += math.log(whole)
            n[b] += 1
            for i, x in enumerate(parts):
                sums[b][i] += x / whole
        for b in weights:
            used = b // 64 + 1
            weights[b] = tuple((sums[b][i] + 1) / (n[b] + used) if i < used else 0.0 for i in range(order + 1))
        if last is not None and gain / sum(n.values()) - last < lm.MIN_GAIN:
            break
        last = gain / sum(n.values())
    return weights


def brute(rows, order):
    train = [(k, t) for k, t in rows if _crc(k) % 7 != 2]
    kept = _counts([t for k, t in train if _crc(k) // 7 % lm.DELETED_EVERY], order)
    held = [t for k, t in train if _crc(k) // 7 % lm.DELETED_EVERY == 0]
    weights = _learn([e for t in held for e in _events(kept, t, order)], order) if kept[1] else {}
    mixture = lm.Mixture(order, weights)
    seen = _counts([t for _, t in train], order)
    for k, t in rows:
        words = _tokens(t)
        base = sum(math.log10((seen[0][0][(w,)] + 1) / (seen[1] + len(seen[0][0]) + 1)) for w in words)
        score = sum(math.log10(sum(x * y for x, y in zip(p, mixture._weights(b)))) for b, p in _events(seen, t, order))
        yield k, _crc(k) % 7 == 2, len(words), sum((w,) in seen[0][0] for w in words), seen[1], base, score


def _frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, score string, slice int")


def _same(got, rows, order):
    want = sorted(brute(rows, order), key=repr)
    have = sorted([tuple(r) for r in got.collect()], key=repr)
    assert len(have) == len(want)
    for a, b in zip(sorted(have, key=lambda r: (repr(r[:5]), r[5])), sorted(want, key=lambda r: (repr(r[:5]), r[5]))):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_counting(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_CHARS", 3_000)
    monkeypatch.setattr(lm, "PART_CHARS", 4_000)
    rng = np.random.default_rng(order)
    vocabulary = ["the", "The", "of", "Ünder", "a-b", "éa", "x y", *(f"w{i}" for i in range(60))]
    rows = []
    for i in range(300):
        picks = np.minimum(rng.zipf(1.3, size=rng.integers(0, 40)) - 1, len(vocabulary) - 1)
        rows.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(vocabulary[j] for j in picks)))
    rows += rows[:20] + [(1000, None), (1001, ""), (1002, " \n\t "), (None, "the of"), (None, None), (7, "other text")]
    rows += [(2000 + i, "the same text again and again") for i in range(150)]
    rows += [(5000, " ".join(f"w{i % 50}" for i in range(5_000)))]
    _same(lm.score(_frame(spark, rows), order=order), rows, order)


@pytest.mark.parametrize("rows", [[], [(0, "a b")], [(i, None) for i in range(30)], [(5, "only held out")], [(2, "x"), (5, "x")]])
def test_small_tables(spark, rows):
    _same(lm.score(_frame(spark, rows)), rows, lm.ORDER)


def test_no_training_text(spark):
    held = [(i, "a b c") for i in range(100) if _crc(i) % 7 == 2]
    got = lm.score(_frame(spark, held)).collect()
    assert len(got) == len(held) and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in got)


def test_better_than_single_words(spark):
    """On documents that the model has not seen, the mixture is likelier than smoothed single words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm.score(docs)
    _same(got, rows, lm.ORDER)
    held = got.filter("held_out").toPandas()
    assert held["score"].sum() > held["base_score"].sum()


def test_packing_of_numbers():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1 << 63), (1000, 1 << 63), (5, 300), (3, 4)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        low = int(values[0]) // 2
        assert (lm.unpack_sorted(lm.pack_sorted(values, low), len(values), low) == values).all()
        counts = rng.integers(0, min(top, 1 << 40), n)
        assert (lm.unpack_counts(lm.pack_counts(counts), n) == counts).all()
