"""Connected components of a table of links, by rounds of joins over tables in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswatch.llm.common import written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b of type long): root is the smallest node that can be reached.

    Alternates large stars (each node hands its larger neighbours to its smallest one) and small stars (its smaller ones
    too); this ends in stars around the roots after a number of rounds that grows with the logarithm of the longest
    path.  No round gathers a neighbourhood: only its smallest member is aggregated, and the links of a node of very many
    are rows like others in a join that Spark splits when skewed.  Null ends and links of a node to itself count for
    nothing beyond naming the node.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    pairs = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pairs = pairs.where("a <> b")
    before = None
    for _ in range(ROUNDS):
        # Large star: every neighbour above a node is linked to the smallest of the node and its neighbours.
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.select(F.col("b").alias("a"), F.col("a").alias("c")).join(least, "a").select(F.col("c").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        # Small star: every neighbour below a node, and the node, are linked to the smallest neighbour.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        pairs = written(small.where("a <> b").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left") \
        .select("node", F.coalesce("root", "node").alias("root"))
