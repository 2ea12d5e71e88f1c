"""Connected components of an edge list, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK = 4096  # edges of one node in a task's block


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node of its own.

    Each round takes the smallest label among a node and its neighbours, then follows labels one
    step further (pointer jumping), so long chains take a logarithmic number of rounds. Every round
    is written to the shared folder. The edges of a node of more than BLOCK edges are dealt over blocks,
    each of which gets the node's label once.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    hot = both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("b", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    hot = stored(hot, "hubs")
    both = stored(both.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("blocks")), F.lit(0)).cast("int").alias("block")), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("component")), "labels")
    while True:
        sent = labels.join(hot.withColumnRenamed("b", "node"), "node", "left").select(F.col("node").alias("b"), "component", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
        near = both.join(sent, ["b", "block"]).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("m"), F.col("component").alias("was"))
        of = labels.select(F.col("node").alias("n"), F.col("component").alias("up"))
        new = new.join(of, F.col("m") == F.col("n"), "left").select("node", F.least("m", F.coalesce("up", "m")).alias("component"), "was")
        new = stored(new, "labels")
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
