"""Connected components of a graph in tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmap.sources.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long) that reaches a smaller one; root is the
    smallest it reaches.

    Alternating large-star and small-star steps: each round ties nodes to the smallest
    neighbour, so the number of rounds grows with the logarithm of the longest path.  Every
    round is written to the shared folder; only a count and a checksum reach the driver.
    The smallest neighbours are aggregated before the shuffle, and nodes with very many edges
    only occur on the split side of joins.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, seen = materialize(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.where("u > v").distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
