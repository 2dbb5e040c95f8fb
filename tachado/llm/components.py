"""Connected components of a table of links, by rounds over the table; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tachado.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node that links lead to.

    Each round, every node hands the smallest node it knows to the others it knows and points to that one itself; this
    halves long chains, and groups of any size are counted by map-side minimums, never gathered.
    """
    edges = written(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy(F.col("low").alias("node")).agg(F.least(F.min("high"), F.col("low")).alias("least"))
        # To the smallest neighbour: from the node itself, and from each larger neighbour.
        handed = both.where("high > low").join(least, F.col("low") == F.col("node")).select(F.col("least").alias("low"), "high")
        own = least.where("least < node").select(F.col("least").alias("low"), F.col("node").alias("high"))
        large = written(handed.unionByName(own).where("low < high").distinct(), "links")
        # Then among the smaller neighbours of each node only the smallest is kept as its own, and the others point to it.
        small_least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        joined = large.join(small_least, F.col("high") == F.col("node"))
        moved = joined.where("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
        after = written(small_least.select(F.col("least").alias("low"), F.col("node").alias("high")).unionByName(moved).distinct(), "links")
        marks = [df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first() for df in (edges, after)]
        edges = after
        if marks[0] == marks[1]:
            break
    members = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return members.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
