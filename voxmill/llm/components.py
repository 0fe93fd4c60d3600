"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) to (node, label), label the least node of its component,
    for every node of a link.

    Each round hooks every node to its least neighbour, jumps pointers until all
    point to the roots of their trees, and contracts the links to roots. Roots are
    local minima, so a round at least halves the nodes that still have links, and
    a tree of depth d takes log2(d) jumps. All state stays in written tables."""
    edges = materialize(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("r")), "hooks")
        while True:
            to = hooks.select(F.col("a").alias("r"), F.col("r").alias("next"))
            jumped = materialize(hooks.join(to, "r").select("a", F.col("next").alias("r"), (F.col("next") < F.col("r")).alias("moved")), "jumps")
            hooks = jumped.select("a", "r")
            if jumped.where("moved").isEmpty():
                break
        renamed = hooks.select(F.col("a").alias("label"), "r")
        labels = hooks.toDF("node", "label") if labels is None else materialize(labels.join(renamed, "label", "left").select("node", F.coalesce("r", "label").alias("label")), "labels")
        a, b = hooks.toDF("a", "ra"), hooks.toDF("b", "rb")
        edges = materialize(edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "links")
        if edges.isEmpty():
            return labels
