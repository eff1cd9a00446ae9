"""Connected components of an edge table, by alternating star contraction.

Large star: every node hands its greater neighbours to its least neighbour.
Small star: every node hands its smaller neighbours to the least of them.
Repeated until nothing changes, each component is a star around its least node.
Rounds grow with the logarithm of the component size.  Minima are partial
aggregates and joins, so a node with a third of all edges is no unbounded group
(AQE splits its join partitions).  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.session import materialise, superseded


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    near = _both(e)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its least node.

    Repeated edges, either direction and self edges are fine; edges with a NULL
    end are ignored; a node with self edges only is a component of its own.  An
    empty table gives an empty result.
    """
    edges = edges.dropna(subset=["u", "v"]).select("u", "v").distinct()
    seal = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    alone = edges.where("u = v").select("u").distinct()
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, seen = materialise(links, "links", **seal)
    while seen["n"]:
        before, old = seen, state
        state, seen = materialise(_small_star(_large_star(state)), "links", **seal)
        superseded(old)
        if seen == before:
            break
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = stars.unionByName(roots)
    rest = alone.select(F.col("u").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(rest)
