"""Chat formatting: reply trees, their root-to-leaf paths, and each chosen path as one conversation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfill.session import materialize

# The template: ``### role ###`` newline, text, ``</turn>`` newline. In roles and texts every backslash becomes ``\\b``, every
# ``#`` becomes ``\\h`` and every ``<`` becomes ``\\l``; so no control string, nor part of one, occurs inside them.
TURN_END = "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), escape(role), F.lit(" ###\n"))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row per node: of rows that share one the smallest by parent, role, text and score; a null node is no message."""
    named = messages.filter("node is not null")
    if named.groupBy("node").count().filter("count > 1").isEmpty():
        return named
    first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return named.groupBy("node").agg(first).select("node", "m.parent", "m.role", "m.text", "m.score")


def jumps_of(messages: DataFrame) -> list[DataFrame]:
    """Jump tables, by self-joins that double the jump each time.

    ``messages`` has ``node`` (unique), ``parent`` (a node, or null for a root) and ``score`` (null: 0). Table ``k`` has
    ``node, up, up_level, sum`` of every node with 2^k ancestors: the last of these, the highest table that this one is in
    (null: it is a root), and the scores of the node and the 2^k - 1 above it. A tree of depth d takes log2(d)
    joins, and a node is in as many tables as its own depth asks for, however deep other trees are. Every table is
    stored, so a lost executor costs no earlier join. A parent that does not exist makes a root; nodes on a cycle
    would climb for ever, so they raise ValueError.
    """
    known = messages.select(F.col("node").alias("up"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum")
    step = materialize(messages.select("node", F.col("parent").alias("up"), score).join(known, "up", "left_semi").select("node", "up", "sum"), "reply-jump")
    n = messages.count()
    tables = []
    while not step.isEmpty():
        if 1 << len(tables) > n:
            raise ValueError("replies form a cycle")
        tables.append(step)
        above = step.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"))
        step = materialize(step.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum")), "reply-jump")
    if not tables:
        return []
    levels = reduce(DataFrame.unionByName, [t.select("node", F.lit(k).alias("level")) for k, t in enumerate(tables)])
    levels = materialize(levels.groupBy("node").agg(F.max("level").alias("level")), "reply-level")
    up_level = levels.select(F.col("node").alias("up"), F.col("level").alias("up_level"))
    return [materialize(t.join(up_level, "up", "left").select("node", "up", "up_level", "sum"), "reply-jump") for t in tables]


def climb(leaves: DataFrame, messages: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``leaf, root, depth, sum`` of every leaf (a column ``node``): its root, and the scores along its branch.

    From the longest jump down a leaf that can jump 2^k does, and goes on from where it lands. A leaf takes part in
    as many joins as its depth has ones in binary.
    """
    at = leaves.select(F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("sum"))
    if jumps:
        tops = reduce(DataFrame.unionByName, [t.select(F.col("node").alias("at"), F.lit(k).alias("level")) for k, t in enumerate(jumps)])
        tops = tops.groupBy("at").agg(F.max("level").alias("level"))
        at = materialize(at.join(tops, "at", "left").select("leaf", "at", "level", "depth", "sum"), "reply-place")
        for k in range(len(jumps) - 1, -1, -1):
            far = at.filter(F.col("level") == k)
            jump = jumps[k].select(F.col("node").alias("at"), "up", "up_level", F.col("sum").alias("more"))
            moved = far.join(jump, "at").select(
                "leaf", F.col("up").alias("at"), F.col("up_level").alias("level"), (F.col("depth") + (1 << k)).alias("depth"), (F.col("sum") + F.col("more")).alias("sum")
            )
            at = materialize(at.filter(F.col("level").isNull() | (F.col("level") != k)).unionByName(moved), "reply-place")
    own = messages.select(F.col("node").alias("at"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("own"))
    return at.join(own, "at").select("leaf", F.col("at").alias("root"), "depth", (F.col("sum") + F.col("own")).alias("sum"))


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of every tree, one row per node on one: ``root, leaf, rank, node, depth``.

    A branch's score is the sum of ``score`` (null: 0) along it; equal ones go by depth (longer first), then by leaf.
    Leaves climb to their root by jumps; the chosen leaves' ancestors are then marked from the longest jump down,
    so the rows written are the chosen paths' nodes, never a path per node. Nodes are unique (see
    :func:`distinct_messages`); an empty table has no branch.
    """
    jumps = jumps_of(messages)
    inner = messages.select(F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = climb(messages.select("node").join(inner, "node", "left_anti"), messages, jumps)
    order = Window.partitionBy("root").orderBy(F.desc("sum"), F.desc("depth"), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    on = materialize(chosen.select("root", "leaf", "rank", F.col("leaf").alias("node"), "depth"), "reply-branch")
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].select("node", "up")
        above = on.join(jump, "node").select("root", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        on = materialize(on.unionByName(above).distinct(), "reply-branch")  # else every step would double the plan
    return on


def format_branches(messages: DataFrame, top: int = 1, trained: str = "assistant") -> DataFrame:
    """Each chosen branch as one conversation: ``root, leaf, rank, n_turns, formatted, loss_spans``.

    ``messages`` has ``node, parent, role, text, score``. ``loss_spans`` are the code points (start, end exclusive) of the
    texts of ``trained`` turns in ``formatted``: the escaped text without head and end mark. Null roles and texts are
    empty. One conversation is one row, so its turns meet in one task; their texts are joined to it only there.
    Rows without a node are left out; of several with one node the smallest counts. Other columns are not read.
    """
    messages = distinct_messages(messages)
    path = branches(messages, top).join(
        messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "node"
    )
    turn = path.select(
        "root", "leaf", "rank", "depth", _head(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("loss")
    ).withColumn("size", F.char_length("head") + F.char_length("body") + len(TURN_END))
    before = Window.partitionBy("root", "leaf", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head")
    turn = turn.select(
        "root", "leaf", "rank", "depth", F.concat("head", "body", F.lit(TURN_END)).alias("turn"),
        F.when(F.col("loss"), F.struct(start.alias("start"), (start + F.char_length("body")).alias("end"))).alias("span"),
    )
    rows = turn.groupBy("root", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "span"))).alias("turns"))
    return rows.select(
        "root", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.array_compact(F.transform("turns", lambda t: t["span"])).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as ``(role, text)`` structs; what :func:`format_branches` wrote, exactly."""

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, " ###\n")
        return F.struct(
            unescape(F.substring(piece, F.lit(5), cut - 5)).alias("role"),
            unescape(F.substring(piece, cut + 5, F.char_length(piece))).alias("text"),
        )

    pieces = F.split(formatted, TURN_END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    parts = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(parts, "")


def chains(turns: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Reply trees of plain conversations: every row answers the one before it. Adds ``node, parent, score``.

    Rows of a null conversation are one conversation; equal turn numbers go on by role and text.
    """
    by = Window.partitionBy(tree).orderBy(order, "role", "text")
    name = F.coalesce(F.col(tree).cast("string"), F.lit("null"))
    at = F.row_number().over(by)
    return turns.select(
        F.col(tree), "role", "text",
        F.concat_ws("/", name, at.cast("string")).alias("node"),
        F.when(at > 1, F.concat_ws("/", name, (at - 1).cast("string"))).alias("parent"),
        F.lit(0.0).alias("score"),
    )
