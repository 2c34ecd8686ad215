"""Connected components of a table of links, by alternating stars; labels are the smallest node of each component.

Defined results. Links of a node with itself, repeated and reversed links, extra columns: no effect. A link with a null
end: left out. No links: no rows. Components that have not settled after `rounds` rounds: an error, never unfinished labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ._shared import remove, written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on directed edges (u, v): every v beyond u (or up to it) is tied to the least neighbour of u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if larger:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, at: str, *, rounds: int = 50) -> DataFrame:
    """node, label for every node of links (x, y); at: a folder for the tables between rounds."""
    spark = links.sparkSession
    edges = written(links.select(F.col("x").alias("u"), F.col("y").alias("v")).filter("u <> v").distinct(), f"{at}/0")
    seen: Row | None = None
    for i in range(1, rounds + 1):
        last, edges = f"{at}/{i - 1}", written(_stars(_stars(edges, True), False), f"{at}/{i}")
        remove(spark, last)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    # every node but the least of its component has one edge, to that
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
