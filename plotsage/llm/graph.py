"""Connected components of a graph held as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.llm.common import cut, discard


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Minima are cut off first, so that a hub's join can be split."""
    ways = _both_ways(edges)
    least = cut(ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "graph-least")
    large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    large = cut(large, "graph-large")  # u > v from here on
    discard(least)
    least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "graph-least")
    small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    found = cut(small.filter("u <> v").distinct(), "graph-small")
    discard(large, least)
    return found


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node that has an edge, but for the roots. Edges are u, v.

    Loops and repeated edges do no harm; null ends are left out; no edges give no rows. Each round shortens all paths to
    the roots; the number of rounds grows with the logarithm of the longest path.
    """
    at = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "graph-edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(at)
    for _ in range(rounds):
        last, at = at, _stars(at)
        discard(last)
        after = mark(at)
        if after == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"no fixed point after {rounds} rounds")
