"""Packing against the public tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gapfill.llm import packing
from gapfill.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def wanted(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, tokenizer):
    """Every id of every row in one piece, sequences without gaps, sizes that need no padding."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for doc, parts in docs.items():
        ids = wanted(tokenizer, texts[doc])
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            mine = np.array(ids[at : at + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(mine.tobytes())
            assert list(p.ids) == list(mine)
            at += p.length
        assert at == len(ids)
    for parts in seqs.values():
        parts.sort(key=lambda p: p.offset)
        ends = [0, *np.cumsum([p.length for p in parts])]
        assert [p.offset for p in parts] == ends[:-1]
        assert ends[-1] == parts[0].tier <= 2048 and ends[-1] & (ends[-1] - 1) == 0


def test_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer)


def test_odd_texts(spark, tokenizer):
    rng = random.Random(5)
    alphabet = "abzABZéÉßÿ×²ⅷΣσςİKſœŒ'’s 1 23.,!|#%&-_\t\n 　́ẞ中文字🙂<|endoftext|>"
    texts = {i: "".join(rng.choices(alphabet, k=rng.randint(0, 60))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "  \n ", 303: "word " * 30_000, 304: "x" * 5_000, 305: "<|endoftext|> a", 306: "Don't WE'LL it's"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    check(packing.pack(docs).collect(), texts, tokenizer)


def test_same_tokens_whatever_the_tasks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = (packing.pack(docs.repartition(n), keep_ids=False).agg({"length": "sum"}).first()[0] for n in (1, 7))
    assert one == many


def test_rows_without_ids_and_empty_table(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as length", "1 as tier").coalesce(1)
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == 3 * 3 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_step_groups_are_balanced(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    packed = materialize(packing.pack(docs, keep_ids=False), "packed")
    rows = packing.step_groups(packed, step_tokens=1 << 14).filter("offset = 0").collect()
    assert len(rows) == packed.filter("offset = 0").count()
    for tier in {r.tier for r in rows}:
        groups = [r.step_group for r in rows if r.tier == tier]
        sizes = [groups.count(g) for g in range(max(groups) + 1)]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= max(1 << 14, tier)
        assert all(0 < r.step_position < 1 for r in rows if r.tier == tier)
