"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least vertex of u's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; edges are held as u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(vertex, component): every vertex of an edge with the least vertex of its component.

    Self-loops and repeated edges are harmless; a null end leaves the edge out; no edges give no rows.  Only two numbers
    per round reach the driver; neighbourhoods are joined, never collected; each round is checkpointed.
    """
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    loops = edges.where("u = v").select("u")
    edges = cut(edges.where("u <> v").distinct().unionByName(loops.select("u", F.col("u").alias("v")).distinct()))
    vertices = edges.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    now, seen = edges.where("u <> v"), None
    for _ in range(MOST_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("connected components did not settle")
    label = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return vertices.join(label, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
