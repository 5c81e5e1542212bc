"""Connected components of a link table by alternating star contraction.

Every round hangs each vertex's larger neighbours on its smallest one
(large star), then its smaller neighbours on the smallest (small star), until
the links no longer change; they are then stars around the smallest vertex of
each component.  A round is two aggregates (minimum per vertex, combined
before the shuffle) and two joins whose hot keys Spark can split, so a vertex
that holds a third of all links is no single task.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(hub_spoke: DataFrame, low: DataFrame) -> DataFrame:
    return hub_spoke.join(low, "u")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` (root: smallest node of its component) for every vertex
    of ``links(u, v)``; loops and repeats are allowed, nulls are ignored."""
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct())
    state = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = _stars(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = materialize(large)
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = (_stars(edges, low).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct())
        edges = materialize(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
