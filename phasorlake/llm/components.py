"""Connected components of a graph in tables, by contraction.

In a round each node takes the least of itself and its neighbours as its parent,
parents are followed twice, and edges are redrawn between parents. Nodes that aren't
a local minimum vanish, so the edges shrink fast; nothing goes to the driver but the
number of edges left. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasorlake.llm import common


def _ends(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, once each."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that it reaches.

    Loops and repeated or turned edges change nothing, but a node that has only a loop has
    no row. Edges with a null end must be taken out before. No edges give no rows. Other
    columns are ignored.
    """
    spark = edges.sparkSession
    left = common.keep(_ends(edges), "edges")
    labels = None
    while not left.isEmpty():
        least = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        up = common.keep(least, "parents")
        over = up.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = up.join(over, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        step = common.keep(step, "steps")
        common.drop(spark, up)

        def climb(table: DataFrame, name: str, step: DataFrame = step) -> DataFrame:
            to = step.select(F.col("node").alias(name), F.col("parent").alias("_to"))
            return table.join(to, name, "left").withColumn(name, F.coalesce("_to", name)).drop("_to")

        if labels is None:
            nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            new = nodes.withColumn("root", F.col("node"))
        else:
            new = labels
        new = common.keep(climb(new, "root"), "labels")
        rest = common.keep(_ends(climb(climb(left, "a"), "b")), "edges")
        common.drop(spark, left, step, labels)
        left, labels = rest, new
    common.drop(spark, left)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return labels
