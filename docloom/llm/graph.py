"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.blocks import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, both: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are tied to the least node around it: the larger ones (large) or the rest (small)."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    pairs = both.join(least, "u")
    if large:
        return pairs.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u != m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that links (u, v) reach, for every node that has a link to another.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until nothing changes.
    Only a count and a sum of hashes come to the driver.  No links: no rows.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _stars(edges, both, True).where("u != v").distinct()
        edges = cut(_stars(edges, edges, False).where("u != v").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
