"""Connected components of a graph that is never gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, class`` of every node of ``links`` (``x, y``); a class is named by its smallest node.

    Every round takes the smallest class among a node's neighbours, then that class's own class, so distances halve
    and stars settle in two rounds. Each round is stored: a lost executor costs one round. Sums over a hot node's links
    form before the shuffle, and what meets it in a join is one row per link, which Spark splits.
    """
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    edges = materialize(both.filter("x <> y").distinct(), "links")
    near = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y"))
    label = materialize(near.select("node", F.least("node", "y").alias("class")), "classes")
    while True:
        seen = edges.join(label.select(F.col("node").alias("y"), F.col("class").alias("other")), "y")
        least = seen.groupBy(F.col("x").alias("node")).agg(F.min("other").alias("other"))
        step = label.join(least, "node").select("node", F.col("class").alias("before"), F.least("class", "other").alias("via"))
        up = label.select(F.col("node").alias("via"), F.col("class").alias("over"))
        step = step.join(up, "via").select("node", "before", F.least("via", "over").alias("class"))
        step = materialize(step, "classes")
        label = step.select("node", "class")
        if step.filter("class <> before").isEmpty():
            return label
