"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for every node that has an edge.

    Each round takes the smallest label among the neighbours and then the label of that label, so distances halve; tables
    are written between rounds and nothing but a count of changes comes to the driver.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["node"] == near["src"]).select("node", "component", F.least("component", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        after = written(low.join(jump, "low", "left").select("node", "component", F.least("low", "root").alias("next")), "labels")
        changed = after.filter("next != component").limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
