"""Connected components by alternating large-star and small-star rounds on DataFrames (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpoint


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for each node of ``links`` (a long, b long); root is the smallest node of its component, smallest nodes included.

    Each round aggregates the smallest neighbour of each node with partial sums and joins it back, so that a hub's
    links are never gathered in one task: the join is one that Spark may split.  Lineage is cut every round.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = checkpoint(edges), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
