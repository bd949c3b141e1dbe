"""Connected components of a large graph by alternating stars.

Each round rewires every link towards the least neighbour: first the larger
neighbours of a node (large star), then the smaller ones (small star). Nothing is
grouped into lists; a hub is one aggregated minimum and a join that Spark may
split. Rounds are few (their number grows with the logarithm of the longest
chain) and each is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomline.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b), root the least node of its component."""
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        large = large.distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        edges = stage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lower.select("u", F.col("m").alias("v"))).distinct(),
            "stars",
        )
        mark = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
        ).first()
        if mark == before:
            break
        before = mark
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return rooted.union(roots)
