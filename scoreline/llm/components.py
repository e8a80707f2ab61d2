"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _linked(edges: DataFrame, of: str) -> DataFrame:
    """Pairs (x, y) with the smallest neighbour of x, or x itself, as m. The minima are written
    first: joined from a table, a node with very many neighbours is split at run time."""
    low = edges.groupBy(of).agg(F.min("y").alias("m")).withColumn("m", F.least("m", of))
    return edges.join(cut(low, "minima"), of)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: long columns a and b. Returns node and component, the smallest node reachable, for
    every node with an edge to another node. Nulls and edges of a node to itself are left out.

    Large-star and small-star steps in turn: every step links neighbours to the smallest node among
    them, until all that is left are stars. The number of rounds grows with the logarithm of the
    longest path; every round starts from a written table.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(pairs.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y"))
        both = both.union(now.select(F.col("v"), F.col("u")))
        large = _linked(both, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "edges")
        down = large.select(F.col("u").alias("x"), F.col("v").alias("y"))
        small = _linked(down, "x")
        small = small.select(F.col("y").alias("u"), F.col("m").alias("v")).union(small.select("x", "m"))
        now = cut(small.where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )
