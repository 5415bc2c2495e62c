"""The pipeline's stages, each against plain Python on what the stage before kept, and planted cases."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from gapfill.llm import decontam, line_dedup, near_dedup, quality_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, shared passages, benchmark passages, junk, and clean ones."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(5)]
    passage = text(60)
    clean = [text(120) + "\n" + text(40) + "." for _ in range(60)]
    docs = list(enumerate(clean))
    docs += [(100 + i, clean[i]) for i in range(5)]  # copies
    docs += [(200 + i, clean[10 + i].replace("\n", " ").rsplit(" ", 2)[0] + " xx yy") for i in range(5)]  # near, as other lines
    docs += [(300 + i, text(60) + "\n" + passage + "\n" + text(60)) for i in range(4)]
    docs += [(400 + i, text(50) + " " + items[i][1] + " " + text(50)) for i in range(5)]
    docs += [(500 + i, " ".join(["###", "$$$", "&&&"] * 60) + str(i)) for i in range(40)]
    rows = [(d, t, "en", "src", len(t)) for d, t in docs]
    labels = [(d, int(d < 500), 0) for d, _ in docs]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, frame = {r.doc_id: r for r in docs.collect()}, docs
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        kept[name] = {r.doc_id for r in rows}
        if name != "packing":
            assert docs.columns == COLUMNS and len(rows) == len(kept[name])
        if name == "quality_classifier":
            assert kept[name] == {d for d in before if d < 500}
        elif name == "line_dedup":
            lost = {r.doc_id: set(r.removed) for r in line_dedup.find(frame).collect()}
            want = {d: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in lost[d]) for d, r in before.items()}
            assert {r.doc_id: r.text for r in rows} == {d: t for d, t in want.items() if t.strip()}
            assert all(r.n_chars == len(r.text) for r in rows)
            assert not kept[name] & set(range(100, 105)) and {r.doc_id: r.text.count("\n") for r in rows}[300] == 2
            assert all(r.text.count("\n") == 1 for r in rows if 301 <= r.doc_id <= 303)
        elif name == "minhash_near_dedup":
            groups = {r.doc_id: r.class_id for r in near_dedup.classes(frame).collect()}
            assert kept[name] == {d for d in before if groups[d] == d} and not kept[name] & set(range(200, 205))
        elif name == "benchmark_decontamination":
            hit = {r.doc_id for r in decontam.contamination(frame, spark.read.parquet(f"{folder}/benchmark.parquet")).filter("size(hits) > 0").collect()}
            assert hit == set(range(400, 405)) and kept[name] == set(before) - hit
        else:
            sizes = Counter()
            for r in rows:
                assert r.length == len(r.ids) and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
                sizes[r.doc_id] += r.length
            assert {d: r.doc_tokens for d in before for r in rows if r.doc_id == d} == dict(sizes)
    assert set(range(60)) <= kept["benchmark_decontamination"]


def test_run_and_names(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 60 and {"sequence_id", "step_group", "ids"} <= set(out.columns)


def test_extra_columns_nulls_and_empty_table(spark, folder):
    names = ("key", "text_key", "content_key", "stats", "score", "lines_lost", "n", "class", "kept_id")
    rows = [(None, None, "en", "s", None), (1, "", None, None, 0), (2, "one two three", "en", "s", 13), (2, "one two three", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *(f"'v' as {n}" for n in names))
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, folder).columns == docs.columns, name
            stage(spark, df, folder).collect()
        corpus_pipeline.STAGES[-1][1](spark, df, folder).collect()
    assert quality_model.statistics(None) == quality_model.statistics("")
