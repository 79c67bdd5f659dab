"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evplace.llm._shared import dropped, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, name: str = "links") -> DataFrame:
    """id, component (the smallest id reachable) for every id that has a link; ids must not be null.

    Each round replaces the links of an id by links to the smallest id beside it, first for larger
    neighbours, then for smaller ones, and a round's links are never more than those before it.
    The smallest neighbour is a partial aggregate and comes back by an equi-join, so a hub with
    very many links is one small value, never a collected list. Every round is a written table, which
    cuts the lineage; rounds grow with the logarithm of the longest chain.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), name)
    before = _mark(edges)
    while before[0]:
        # large star: each id links its larger neighbours to the smallest one of itself and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each id links its smaller neighbours, and itself, to the smallest
        large = written(large.distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(large)
        dropped(edges)
        edges, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
