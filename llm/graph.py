"""Connected components of an edge table, by alternating star contractions.

Each round replaces the edges by edges to the smallest neighbour, first for
the larger neighbours of every node, then for the smaller ones, until every
component is a star around its smallest node (the published large-star /
small-star method).  Edges stay in tables; the driver sees two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.scratch import drop, save


def _to_smallest(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction of edges (u, v), u > v."""
    if larger:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    # The smallest neighbour is stored first, so the join below deals both
    # sides anew and a node with very many neighbours can be split.
    least = save(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    met = sides.join(least, "u")
    if larger:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    done = save(out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    drop(least)
    return done


def _shape(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``pairs``; component is its smallest node."""
    edges = save(pairs.filter(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    shape = _shape(edges)
    while shape[0]:
        wide = _to_smallest(edges, True)
        star = _to_smallest(wide, False)
        drop(edges, wide)
        edges, before = star, shape
        shape = _shape(edges)
        if shape == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
