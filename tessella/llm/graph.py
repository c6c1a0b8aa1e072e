"""Connected components as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, renamed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for undirected edges (a, b): label is the smallest node of the component.

    Each round a node takes the smallest label among its neighbours, then its label's label, so that paths halve. A
    node with very many neighbours is no group of its own: its label goes to them by a join and theirs come back as a
    minimum that is taken before the shuffle. Rounds are tables in the shared folder, deleted once the next is there.
    Labels only fall and are nodes of their component, so it ends, when nothing changes, for every graph.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "graph-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "graph-labels")
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, labels["node"] == heard["a"]).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        hooked = materialize(hooked, "graph-hooked")
        above = hooked.select(F.col("node").alias("up"), F.col("label").alias("over"))
        jumped = hooked.join(above, hooked["label"] == above["up"]).select("node", "old", F.col("over").alias("label"))
        before, labels = labels, materialize(jumped, "graph-labels")
        discard(before, hooked)
        if labels.where("label <> old").isEmpty():
            discard(both)
            return renamed(labels, labels.drop("old"))
        labels = labels
