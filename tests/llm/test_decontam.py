"""Decontamination against a search in plain Python."""

import random
import re

import pytest

from gapfill.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((doc if doc is not None else -1, len(w), sorted(hit), sorted(str(f) for f in found if f is not None)))
    return sorted(out)


def tables(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "'w' as w", "2 as len", "3 as items").repartition(3),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'g' as gram", "4 as h"),
    )


def data():
    rng = random.Random(6)
    vocabulary = ["The", "of", "é", "É", "x1", "a-b", "don't", "中文", "END."]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(None, text(12)), (3, text(15)), (20, None), (21, "!!")]
    docs = [(i, text(rng.randint(0, 40)) + " " + (rng.choice(items)[1] or "") + "; " + text(5)) for i in range(60)]
    return [*docs, (None, None), (1, ""), (1, ""), (7, text(30_000))], items


@pytest.fixture(params=["broadcast", "shuffle", "shuffle both"])
def branch(request, monkeypatch):
    """The windows are broadcast, or joined by shuffle; the texts that they hit then by broadcast or by shuffle."""
    if request.param != "broadcast":
        monkeypatch.setattr(decontam, "MAX_BROADCAST_WINDOWS", 0)
    if request.param == "shuffle both":
        monkeypatch.setattr(decontam, "MAX_BROADCAST_TEXTS", 0)


def test_against_brute_force(spark, branch):
    docs, items = data()
    d, b = tables(spark, docs, items)
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, r.hits, r["items"]) for r in decontam.contamination(d, b).collect()]
    assert sorted(got) == brute(docs, items)


def test_removal_of_repeated_and_long_rows(spark, branch):
    item = " ".join(f"b{i}" for i in range(12))
    long = "Start; " + "filler word " * 20_000 + item.upper() + ". tail " * 3
    docs = [(1, long), (1, long), (2, long), (None, item), (None, None), (5, "clean"), (5, "clean")]
    d, b = tables(spark, docs, [(1, item), (1, item)])
    want = [t if t in (None, "clean") else "" if t == item else t.replace(item.upper() + ". ", "") for _, t in docs]
    got = [r.text for r in decontam.decontaminate(d, b, remove="spans").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r.text or "" for r in decontam.decontaminate(d, b).collect()) == ["", "clean", "clean"]


def test_removal(spark, branch):
    docs = [(1, "clean text."), (2, "Some words: " + " ".join(f"b{i}" for i in range(12)) + ", and the end!"), (3, None), (4, "")]
    d, b = tables(spark, docs, [(1, " ".join(f"B{i}" for i in range(12)))])
    assert sorted(r.doc_id for r in decontam.decontaminate(d, b).collect()) == [1, 3, 4]
    spans = decontam.decontaminate(d, b, remove="spans")
    assert {r.doc_id: r.text for r in spans.collect()} == {1: "clean text.", 2: "Some words: and the end!", 3: None, 4: ""} and spans.columns == d.columns
    assert decontam.decontaminate(d, b.limit(0)).count() == 4 and decontam.contamination(d.limit(0), b).count() == 0
