"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm.common import shared_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the smallest node reachable.

    Every round takes the least label among neighbours and then the label's own label, so
    labels travel twice as far each round. Rounds are cut by checkpoint(). Self-loops and
    repeated edges are allowed; no edges give no rows. Rounds go on until no label moves.
    """
    shared_dir(edges.sparkSession)
    links = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    labels = labels.select("node", F.least("node", "root").alias("root")).checkpoint()
    while True:
        near = (
            links.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        stepped = labels.join(near, "node").select("node", "root", F.least("root", "other").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        after = stepped.join(jump, "new").select("node", F.least("new", "far").alias("root"), (F.least("new", "far") != F.col("root")).alias("moved")).checkpoint()
        labels = after.select("node", "root")
        if after.where("moved").isEmpty():
            return labels
