"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.store import stored


def _hang(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(u, v, m): every edge with the least of u and u's neighbours v."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b); the component is its least vertex.

    Alternates two steps until nothing changes: every vertex hangs its larger
    neighbours on its least neighbour, then its smaller ones.  Rounds grow with
    the logarithm of the number of vertices, no step gathers a vertex's
    neighbours in one row, and a join may split a vertex with very many.
    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hang(both, "a", "b").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        hung = _hang(large, "a", "b")
        small = hung.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct()
        now = stored(small, "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("v")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("v")))
