"""Connected components by label propagation with written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloam.operators.shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for all nodes of ``edges`` (a, b) with a neighbour.

    In each round all nodes of a label's neighbourhood take its least label, and the edges between equal labels go, so
    the number of rounds grows with the logarithm of the longest path. Rounds are written to the shared folder, and a
    round's tables go when the next one is written.
    """
    left = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    found = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")), "components")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("to"))
        hop = least.select(F.col("a").alias("to"), F.col("to").alias("far"))
        step = stored(least.join(hop, "to").select("a", F.col("far").alias("to")), "steps")
        after = stored(found.join(step.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        ends = left.join(step.select("a", F.col("to").alias("x")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        rest = stored(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left, found, step)
        left, found = rest, after
    discard(left)
    return found
