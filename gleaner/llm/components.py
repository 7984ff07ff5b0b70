"""Connected components of a link table by repeated minima, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut


def _checksum(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes: equal for equal sets, in one aggregation."""
    h = F.xxhash64("u", "v")
    low, high = F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(low), F.lit(0)), F.coalesce(F.sum(high), F.lit(0))).first())


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """links(a, b) → (node, component): the smallest node each node can reach.

    Alternating large-star and small-star steps: every round hangs a node's larger neighbours on the
    smallest one it knows, and its smaller ones likewise, so that the number of rounds grows with
    the logarithm of the longest path, and no node's neighbours are ever collected. Neighbour minima
    are aggregated before the shuffle. Raises if `max_rounds` don't suffice. An empty table gives an
    empty result; self links and repeated links change nothing.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    mark = _checksum(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = cut(small.where("u > v").distinct())
        now = _checksum(after)
        settled, edges, mark = now == mark, after, now
        if settled:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
