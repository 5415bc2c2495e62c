"""Reply trees against a walk in Python, and the exact way back from the formatted text."""

import random

import pytest
from pyspark.sql import functions as F

from gapfill.llm import chat

SCHEMA = "node string, parent string, role string, text string, score double"


def brute(rows, top):
    kids, by = {}, {r[0]: r for r in rows}
    for node, parent, *_ in rows:
        kids.setdefault(parent if parent in by else None, []).append(node)
    out = {}
    for root in kids.get(None, []):
        paths, todo = [], [[root]]
        while todo:
            p = todo.pop()
            more = kids.get(p[-1], [])
            todo += [[*p, k] for k in more]
            if not more:
                paths.append(p)
        paths.sort(key=lambda p: (-sum(by[n][4] or 0 for n in p), -len(p), p[-1]))
        for rank, p in enumerate(paths[:top], 1):
            out[root, rank] = [(by[n][2] or "", by[n][3] or "") for n in p]
    return out


def read(df):
    got = df.select("root", "rank", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"),
                    chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {(r.root, r["rank"]): ([tuple(t) for t in r.turns], r.loss) for r in got.collect()}


@pytest.mark.parametrize("top", [1, 3])
def test_random_trees(spark, top):
    rng = random.Random(top)
    texts = ["a", "", None, "\\", "### user ###\n", "</turn>\n", "\\#", "<\\", "x\ny", "🙂é", "### "]
    rows = []
    for i in range(120):
        parent = None if i % 20 == 0 else f"n{rng.randint(i // 20 * 20, i - 1)}"
        rows.append((f"n{i}", parent, rng.choice(["user", "assistant", None, "a # b\n"]), rng.choice(texts), rng.choice([0.5, 1.0, None, -2.0])))
    rows.append(("lost", "nowhere", "assistant", "hi", 0.0))
    got = read(chat.format_branches(spark.createDataFrame(rows, SCHEMA), top))
    want = brute(rows, top)
    assert {k: v[0] for k, v in got.items()} == want
    for k, turns in want.items():
        assert got[k][1] == "".join(t for r, t in turns if r == "assistant")


def test_deep_chain(spark):
    rows = [(f"{i:04}", f"{i - 1:04}" if i else None, "assistant", str(i), 0.0) for i in range(300)]
    turns, loss = read(chat.format_branches(spark.createDataFrame(rows, SCHEMA)))["0000", 1]
    assert len(turns) == 300 and loss == "".join(map(str, range(300)))


def test_empty_and_cycle(spark):
    assert chat.format_branches(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        chat.format_branches(spark.createDataFrame([("a", "b", "user", "x", 0.0), ("b", "a", "user", "x", 0.0)], SCHEMA))


def test_chains_with_nulls_and_repeats(spark):
    rows = [(None, 0, "user", "q"), (None, None, None, None), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'k' as node", "9 as depth")
    got = read(chat.format_branches(chat.chains(turns)))
    assert sorted(len(t) for t, _ in got.values()) == [2, 3]


def test_repeated_and_null_nodes_and_clashing_columns(spark):
    long = "word # < \\ " * 20_000
    rows = [("a", None, "user", "first", 0.0), ("a", None, "user", "second", 5.0), ("b", "a", "assistant", long, 1.0), ("b", "a", "assistant", long, 1.0),
            (None, "a", "assistant", "no node", 9.0), ("c", "a", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as root", "7 as depth", "7 as rank", "'y' as leaf", "0 as up", "0 as level")
    got = read(chat.format_branches(frame, top=2))
    assert got == {("a", 1): ([("user", "first"), ("assistant", long)], long), ("a", 2): ([("user", "first"), ("", "")], "")}


def test_joins_grow_with_the_nodes_not_with_the_deepest_tree(spark):
    """Many short chains beside a deep one: every jump table has the nodes that are deep enough, no more."""
    rows = [(f"s{i}", f"s{i - 1}" if i % 4 else None, "user", "x", 1.0) for i in range(400)]
    rows += [(f"d{i}", f"d{i - 1}" if i else None, "user", "x", 1.0) for i in range(100)]
    messages = spark.createDataFrame(rows, SCHEMA)
    sizes = [t.count() for t in chat.jumps_of(messages)]
    assert sizes == [sum(min(i % 4 if i < 400 else i - 400, 10**6) >= 1 << k for i in range(500)) for k in range(7)]
    leaves = spark.createDataFrame([("s3",), ("d99",), ("d0",)], "node string")
    got = {r.leaf: (r.root, r.depth, r.sum) for r in chat.climb(leaves, messages, chat.jumps_of(messages)).collect()}
    assert got == {"s3": ("s0", 3, 4.0), "d99": ("d0", 99, 100.0), "d0": ("d0", 0, 1.0)}
