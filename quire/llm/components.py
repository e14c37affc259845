"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links(a, b)``; root is the smallest node of its component.

    Each round ties the larger neighbours of every node to its least neighbour (large star), then
    all smaller neighbours to the least (small star). Minima are combined before they are shuffled
    and rows meet their node's minimum in a plain join that adaptive execution can split, so a node
    that most others are linked to stays cheap. Each round is written to the shared folder.
    Null ends and self-links are ignored; an empty table gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = stage(
        links.filter(a != b).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), "links"
    )
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x", "y")).alias("h")).first()
        if now["n"] == 0 or now == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(
                edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
            )
        before = now
        both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(
            edges.select(F.col("y").alias("u"), F.col("x").alias("v"))
        )
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stage(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct(),
            "large",
        )
        least = stage(large.groupBy("x").agg(F.min("y").alias("m")), "least")
        small = (
            large.join(least, "x")
            .filter("y <> m")
            .select(F.col("y").alias("x"), F.col("m").alias("y"))
            .unionByName(least.select("x", F.col("m").alias("y")))
        )
        edges = stage(small.distinct(), "links")
