"""Connected components of an edge table, by alternating large-star and small-star steps.

Labels, edges and components stay distributed; each step's edges are written to the shared
folder, so a lost executor repeats one step only.  A vertex with very many neighbours is met
by partial aggregation, and by joins against minima that are written first: between two plain
shuffles Spark may split the vertex's neighbours over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import is_small, tidied, written


def _minima(rows: DataFrame, least: Column, small: bool) -> DataFrame:
    """``least`` of each u, so given that a join with it may be split or needs no shuffle."""
    found = rows.groupBy("u").agg(least.alias("m"))
    return F.broadcast(found) if small else written(found, "least")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Neighbours above a vertex are joined to the least of its neighbourhood."""
    near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(near, F.least(F.min("v"), F.col("u")), small)
    return near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """A vertex and its neighbours below it are joined to the least of these."""
    below = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(below, F.min("v"), small)
    moved = below.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u > v, distinct) are stars: no vertex points to two others, or points and is pointed to."""
    one = F.lit(1).cast("long")
    ends = edges.select(F.col("u").alias("id"), one.alias("out"), (one - 1).alias("in")).unionByName(edges.select(F.col("v").alias("id"), (one - 1).alias("out"), one.alias("in")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").isEmpty()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``edges`` (u long, v long; any order, repeats and loops allowed) to rows ``id, component``.

    ``component`` is the least id that links reach.  Only vertices with an edge to another
    vertex are returned, each once; null ends are left out; no edges give no rows.
    """
    with tidied() as keep:
        ends = [F.greatest(F.col("u").cast("long"), F.col("v").cast("long")).alias("u"), F.least(F.col("u").cast("long"), F.col("v").cast("long")).alias("v")]
        now = written(edges.filter("u is not null and v is not null and u <> v").select(*ends).distinct(), "edges")
        small = is_small(now)
        for _ in range(max_steps):
            if _settled(now):
                break
            with tidied() as keep_edges:
                now = keep_edges(written(_small_star(_large_star(now, small).distinct(), small).distinct(), "edges"))
        else:
            raise RuntimeError(f"components did not settle in {max_steps} steps")
        # Settled edges are stars: every u points to the least id of its component.
        ends = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")))
        return keep(written(ends.distinct(), "labels"))
