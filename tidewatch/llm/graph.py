"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of links(a, b); comp is the smallest node that can be reached.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then the rest; nodes with very many
    neighbours are only ever counted by min() and joined, both of which Spark can split. A round's edges are written
    to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    edges = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
        if mark == seen:
            break
        seen = mark
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        small = large.groupBy("v").agg(F.min("m").alias("low"))
        new = large.join(small, "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e")).select("e.*").where("v <> m").distinct()
        before, edges = edges, scratch.cut(new)
        scratch.drop(before)
    return edges.select(F.col("v").alias("node"), F.col("m").alias("comp")).unionByName(edges.select(F.col("m").alias("node"), F.col("m").alias("comp")).distinct())
