"""Alignment by diagonal runs against comparing every byte range, and the query against plain counting."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapfill.llm import alignment


def _plain(ends_a, ends_b):
    """Groups between common ends and all overlaps, by looking at every pair."""
    common = sorted(set(ends_a) & set(ends_b))
    groups, low = [], 0
    for end in common:
        groups.append(([i for i, e in enumerate(ends_a) if low < e <= end], [j for j, e in enumerate(ends_b) if low < e <= end]))
        low = end
    span_a = list(zip([0, *ends_a], ends_a))
    span_b = list(zip([0, *ends_b], ends_b))
    over = [(i, j) for i, (s, e) in enumerate(span_a) for j, (t, f) in enumerate(span_b) if s < f and t < e]
    return groups, over


@settings(deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=60), st.integers(0, 40))
def test_align(marks, tail):
    """Random ends; a long one-to-one tail makes the probing double."""
    a = [i + 1 for i, (x, _) in enumerate(marks) if x]
    b = [i + 1 for i, (_, y) in enumerate(marks) if y]
    more = range(len(marks) + 1, len(marks) + tail + 2)
    a, b = a + list(more), b + list(more)
    left, right = alignment.align(a, b)
    groups, over = _plain(a, b)
    assert list(zip(left, right)) == over
    closes = np.array([a[i] == b[j] for i, j in over], bool)
    ends = np.array(left)[closes], np.array(right)[closes]
    assert [e.tolist() for e in ends] == [[x[-1] for x, _ in groups], [y[-1] for _, y in groups]]
    want = ";".join(",".join(f"{i}" for i in x) + "|" + ",".join(f"{j}" for j in y) for x, y in groups)
    assert alignment.groups_text(np.arange(len(a)), np.arange(len(b)), *ends, alignment.group_names(len(a), len(b))) == want


def test_run_length():
    a = list(range(1000))
    for n in (0, 1, 2, 3, 7, 8, 9, 100, 999, 1000):
        b = [*range(n), *(x + 0.5 for x in range(n, 1000))]
        assert alignment.run_length(a, b, 0, 0) == n
    assert alignment.run_length([1, 2], [1, 2, 3], 0, 0) == 2 and alignment.run_length(a, a, 1000, 1000) == 0
    assert alignment.align([], []) == ([], [])


def _tokenize(text):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a = Tokenizer.from_file(public_tokenizers.path(alignment.FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SECOND))
    assert ByteLevel().decode(a.encode(" " + text, add_special_tokens=False).tokens).encode() == (" " + text).encode()
    # Byte lengths of A's tokens: one letter of a token stands for one byte.
    left = [(t, len(p)) for t, p in zip(a.encode(" " + text, add_special_tokens=False).ids, a.encode(" " + text, add_special_tokens=False).tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, 1 if re.fullmatch("<0x..>", piece) else len(piece.replace("▁", " ").encode())))
    return left, right


def brute(rows):
    found = []
    for key, text in rows:
        left, right = _tokenize(text) if text else ([], [])
        if sum(n for _, n in right) != len((" " + text).encode() if text else b""):
            left, right = [], []
        ends = [list(accumulate(n for _, n in side)) for side in (left, right)]
        groups, over = _plain(*ends)
        found.append((key, left, right, groups, Counter((left[i][0], right[j][0]) for i, j in over)))
    counts = Counter(p for f in found for p in f[4])
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for key, left, right, groups, over in found:
        shown = ";".join(",".join(str(left[i][0]) for i in x) + "|" + ",".join(str(right[j][0]) for j in y) for x, y in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if left else ""
        n_best = sum(n for p, n in over.items() if counts[p] == best[p[0]])
        yield key, len(left), len(right), len(groups), over.total(), n_best, sum(n * counts[p] for p, n in over.items()), sha


@settings(deadline=None, max_examples=400)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=80) | st.text(st.sampled_from(list("ab' \n\t'sllvé½²1.,!ßÀ_<|>\r")), max_size=80))
def test_faster_merger_gives_the_ids_of_the_tokenizer(text):
    both = alignment.vocabularies(alignment.FIRST, alignment.SECOND)
    assert both.merger is not None
    assert both.first_ids(text).tolist() == both.a.encode(text, add_special_tokens=False).ids


def test_faster_merger_on_documents(spark):
    both = alignment.vocabularies(alignment.FIRST, alignment.SECOND)
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert both.first_ids(" " + row["text"]).tolist() == both.a.encode(" " + row["text"], add_special_tokens=False).ids


ODD = [
    None, "", " ", "  two  blanks ", "\n\n\ttabs", "<|endoftext|> and </s> and <s>", "naïve café – ﬁ ½ ①", "日本語のテキスト", "👩‍👩‍👧 🇩🇪",
    "a b　c▁d", "\u0000\u0001", "<0x41> [PAD]", "same", "same", "\r\n end", "x" * 3_000, "word " * 2_000, "﻿bom",
]


@pytest.mark.parametrize("limit", [alignment.MAX_BROADCAST_PAIRS, 20, 0])
def test_against_plain_counting(spark, monkeypatch, limit):
    """The same with all pairs broadcast, with the frequent ones only, and with none."""
    monkeypatch.setattr(alignment, "MAX_BROADCAST_PAIRS", limit or 1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"][:1500]) for r in docs.orderBy("doc_id").limit(60).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "same"), (3, "again"), (3, "again")]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, pairs int, groups string")
    got = [tuple(r) for r in alignment.link_statistics(frame).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_empty_table_and_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_statistics(empty).collect() == []
    one = alignment.aligned(spark.createDataFrame([(1, "Hello worlds")], "doc_id long, text string"), keep_groups=True).first()
    assert one["groups"].count(";") + 1 == one["n_groups"] and hashlib.sha256(one["groups"].encode()).hexdigest() == one["groups_sha256"]
    assert np.sum(one["times"]) == one["n_links"]


def test_runs_shorter_than_a_probe_are_not_probed(monkeypatch):
    """Most runs are short: each of them once cost several slices and a halving."""
    calls = []
    true = alignment.run_length
    monkeypatch.setattr(alignment, "run_length", lambda *args: calls.append(1) or true(*args))
    a = [x for block in range(50) for x in (10 * block + 1, 10 * block + 4, 10 * block + 9)]
    b = [x for block in range(50) for x in (10 * block + 1, 10 * block + 5, 10 * block + 9)]
    left, right = alignment.align(a, b)
    assert not calls
    spans = [[(x, y) for x, y in zip([0, *ends], ends)] for ends in (a, b)]
    want = [(i, j) for i, s in enumerate(spans[0]) for j, t in enumerate(spans[1]) if s[0] < t[1] and t[0] < s[1]]
    assert list(zip(left, right)) == want
