"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import Scratch, materialize


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node reachable. The result is a table of the scratch.

    Rounds of taking the least label among the neighbours and then the label's own label; each round is written to
    the shared folder, the one before is removed, and only whether labels changed comes to the driver. Hubs are reduced in every task
    before the shuffle. Null ends and loops are no edges; without edges there are no rows.
    """
    held, rounds = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges", held)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels", rounds)
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        of = labels.select(F.col("node").alias("of"), F.col("label").alias("own"))
        new = materialize(new.join(of, F.col("mid") == F.col("of"), "left").select("node", "old", F.least("mid", "own").alias("label")), "labels", rounds)
        done = new.where("old <> label").isEmpty()
        rounds.drop(keep=1)
        labels = new.select("node", "label")
        if done:
            held.drop()
            if scratch is not None:
                scratch.paths += rounds.paths
            return labels
