"""Connected components of an edge table, by alternating large and small stars.

Each step rewires edges towards the smallest neighbour: a large star hands every larger neighbour of a vertex to the
smallest one, a small star every smaller one. The edges end as stars around the smallest vertex of each component, after
a number of steps that grows with the logarithm of the size. No component is ever gathered in one task or on the
driver, and each step is a written table, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.spill import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_steps: int = 60) -> DataFrame:
    """(node, component) for each vertex of an edge, component being the smallest vertex that is reachable.

    Edges that are loops give their vertex a row; edges with a null end are left out; an empty table gives no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    loops = pairs.filter("u = v").select("u")
    now = written(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    seen = None
    for _ in range(most_steps):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        stars = _towards_smallest(down)
        small = stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "cc-edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select("v").unionByName(loops.withColumnRenamed("u", "v")).distinct().join(now.select(F.col("u").alias("v")), "v", "left_anti")
    return out.unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _towards_smallest(edges: DataFrame) -> DataFrame:
    """(u, v, m): the smallest of u and its neighbours with each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "_m").alias("m"))
