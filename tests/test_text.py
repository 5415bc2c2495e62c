import datetime
import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapfill.functions.scores import (
    extract_completion,
    label_bins,
    lexicon_gate,
    severity_bucket,
    valid_completion,
)
from gapfill.functions.text import is_blank, label_lookup, ngrams, rate_tag, render_value, row_payload, term_counts
from gapfill.operators.prompts import simple_prompt
from gapfill.operators.tfidf import TfIdf


def column(spark, values, kind="string"):
    schema = T.StructType([T.StructField("v", T._parse_datatype_string(kind)), T.StructField("i", T.IntegerType())])
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], schema)


def apply(spark, values, expr, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expr).collect()]


def test_blank(spark):
    assert apply(spark, [None, "", " ", "\t\n", "  ", "\x1c", " a "], is_blank("v")) == [True] * 6 + [False]


def test_rate_tag(spark):
    assert apply(spark, [0.05, 0.29, 0.3, 1.0, 0.0], rate_tag(F.col("v")), "double") == ["05", "29", "30", "100", "00"]


def test_ngrams(spark):
    got = apply(spark, ["A b_1, c!", "one", "", None], ngrams("v"))
    assert got == [["a", "b_1", "c", "a b_1", "b_1 c"], ["one"], [], []]
    assert apply(spark, ["a bb c dd"], ngrams("v", min_len=2)) == [["bb", "dd", "bb dd"]]
    assert apply(spark, ["a b c"], ngrams("v", (2, 3))) == [["a b", "b c", "a b c"]]


def test_term_counts(spark):
    got = apply(spark, ["b a b", ""], term_counts(ngrams("v", (1, 1))))
    assert [[(t["term"], t["tf"]) for t in row] for row in got] == [[("a", 1), ("b", 2)], []]


def test_render(spark):
    stamp = datetime.datetime(2024, 1, 2, 3, 4, 5, 60)
    assert apply(spark, [1.5, None, float("nan")], render_value("v", T.DoubleType()), "double") == ["1.500", "未知", "未知"]
    assert apply(spark, [True, False, None], render_value("v", T.BooleanType()), "boolean") == ["True", "False", "未知"]
    assert apply(spark, [7, None], render_value("v", T.LongType()), "long") == ["7", "未知"]
    assert apply(spark, ["x", " ", None], render_value("v", T.StringType())) == ["x", "未知", "未知"]
    got = apply(spark, [stamp, stamp.replace(microsecond=0), None], render_value("v", T.TimestampType()), "timestamp")
    assert got == ["2024-01-02T03:04:05.000060", "2024-01-02T03:04:05", "未知"]


def test_payload(spark):
    df = spark.createDataFrame(
        [("t", float("nan"), 3, None, "é\"x", "secret")], "text string, s double, n long, g string, `f?` string, text_original string"
    )
    got = json.loads(df.select(row_payload(df, "text")).first()[0])
    assert got == {"text": None, "s": None, "n": 3, "g": "未知", "f?": 'é"x'}
    assert json.loads(df.select(row_payload(df, "text", True)).first()[0])["text"] == "t"
    assert df.select(simple_prompt(df)).first()[0].splitlines() == ["s: 未知", "n: 3", "g: 未知", 'f?: é"x']


def test_scores(spark):
    values = ["abc", None, "NaN", "1.5", "1.49", "2.5", "3.5", "4.5"]
    assert apply(spark, values, severity_bucket("v")) == ["unknown"] * 3 + ["low", "benign", "medium", "high", "high"]
    assert apply(spark, values, label_bins("v")) == [None, None, None, 1, 0, 2, 3, 4]
    assert apply(spark, values[:4], label_bins("v", keep=True)) == [4, 4, 4, 1]
    assert apply(spark, ["k", "z", None], label_lookup("v", {"k": "Label"})) == ["Label", "z", None]


def test_extract(spark):
    values = [
        '{"text": " a "}', '{"text": 5}', "[1]", 'x {"text":"y"} z', "{bad", "", None, '  {"other": "q"} ', '{"text": ""}',
        '{"a": {"text": "in"}}', 'pre {"text": 1} post',
    ]
    assert apply(spark, values, extract_completion("v")) == [
        "a", '{"text": 5}', "[1]", "y", "{bad", None, None, '{"other": "q"}', "", '{"a": {"text": "in"}}', 'pre {"text": 1} post',
    ]


def test_gates(spark):
    values = ["short", "long enough text", " 123456789 ", "is UNKNOWN to me", "x" * 1201, None]
    assert apply(spark, values, valid_completion("v")) == [False, True, False, False, False, False]
    df = spark.createDataFrame(
        [("red", "high"), ("blue", "high"), ("blue", "medium"), ("red scarlet", "low"), ("green", "benign"), ("blue", "benign"), ("red", "unknown")],
        "t string, l string",
    )
    got = [r[0] for r in df.select(lexicon_gate("t", "l", ["red", "scar"], ["blue"])).collect()]
    assert got == [True, False, True, False, True, False, True]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "k long, t string")
    model = TfIdf("t", 10, ngram=(1, 1)).fit(df)
    got = {(r["k"], r["term"]): r["weight"] for r in model.weights(df, "k").collect()}
    idf = {"a": math.log(3 / 2) + 1, "b": math.log(3 / 3) + 1, "c": math.log(3 / 2) + 1}
    norm1 = math.hypot(2 * idf["a"], idf["b"])
    assert got[(1, "a")] == pytest.approx(2 * idf["a"] / norm1)
    assert got[(2, "c")] == pytest.approx(idf["c"] / math.hypot(idf["b"], idf["c"]))
    assert {k for k, _ in got} == {1, 2}
    unseen = spark.createDataFrame([(9, "zz b")], "k long, t string")
    assert [r["term"] for r in model.weights(unseen, "k").collect()] == ["b"]
    with pytest.raises(ValueError):
        TfIdf("t", 10).fit(df.filter("k = 3"))
    assert TfIdf("t", 1, ngram=(1, 1)).fit(df).terms == ("a",)


def test_words_by_lookup_and_known_terms_equal_full_counts():
    """Bytes are looked up at once and terms outside the vocabulary never put together; both as the expression has it."""
    import random

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from gapfill.operators import terms

    rng = random.Random(3)
    letters = "aaabbz9_  \n\t.-日本٣😀́ß"
    for _ in range(200):
        texts = pa.array(["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 7))], pa.string()).slice(rng.randint(0, 1))
        for min_len in (1, 2):
            words, starts = terms.split_words(texts, min_len)
            want = [[w for w in pc.split_pattern_regex(pa.array([t]), r"[^\p{L}\p{N}_]+")[0].as_py() if len(w) >= min_len] for t in texts.to_pylist()]
            assert [words.to_pylist()[a:b] for a, b in zip(starts, starts[1:])] == want
            for ngram in ((1, 1), (1, 2), (2, 3)):
                names, own, term, times = terms.count_terms(texts, ngram, min_len)
                vocabulary = sorted(names.to_pylist())[::2]
                index = np.array([vocabulary.index(n) if n in vocabulary else -1 for n in names.to_pylist()], np.int64)[term]
                have = index >= 0
                got = terms.KnownTerms(vocabulary, ngram).count(texts, min_len)
                assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(own[have].tolist(), index[have].tolist(), times[have].tolist()))
