"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable, itself included) of every node of edges (a, b).

    Each round takes the smallest label among a node's neighbours and then the label of its label, so that chains halve;
    rounds end when none changes. Labels are written to the shared folder each round. Edges that meet in one node are
    summed where they lie before they are shuffled, and its joins are left to adaptive skew splitting. Loops and repeated
    edges do no harm; edges with a null end are left out.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    both = materialize(pairs.union(pairs.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        offered = both.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("offer"))
        lower = labels.join(offered, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("offer", "component")).alias("component"))
        of = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = lower.join(of, "component", "left").select("node", "was", F.least("component", F.coalesce("next", "component")).alias("component"))
        last, labels = labels, materialize(jumped.select("node", "component", (F.col("was") != F.col("component")).alias("changed")), "labels")
        discard(last)
    discard(both)
    return labels.select("node", "component")
