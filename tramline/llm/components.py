"""Connected components over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, comp): comp is the least node that links reach. Nodes without an edge are left out.

    Each round takes the least label among a node and its neighbours, then that label's own label, so stars take two rounds
    and chains about the logarithm of their length. Minima are partial aggregates and joins may be split, so a node with very
    many edges needs no task for itself; each round's labels are a written table."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        low = cut(labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp")), "labels")
        up = low.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = cut(low.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        if new.filter("comp <> was").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
