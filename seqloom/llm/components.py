"""Connected components of a graph too large for one machine, by alternating large and
small stars: each round points nodes at the smallest node they can see, until every
component is a star around its smallest node. Nodes of very many edges are met by
broadcast, the others by shuffle; rounds are written out, so no lineage grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import attach_groups, materialize, release


def _pointed(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): the edges with the smallest neighbour of u, or u itself."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return attach_groups(edges, least, "u", "n", total).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    """What two equal edge sets share."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its
    smallest node. Loops and repeated links don't matter; no links give no rows."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    for _ in range(rounds):
        total = state[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_pointed(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _pointed(large, total)
        last = edges
        edges = materialize(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        release(last)
        release(large)
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
