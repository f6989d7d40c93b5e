"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (u, v) with u > v: each node's larger neighbours, then its smaller ones, are hung on its least."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    down = large.join(low, "u")
    hung = down.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node reachable, itself included.

    Input (u, v) of one orderable type; loops, repeats and nulls are ignored.
    Each round is stored in the shared folder and the one before removed, so a
    lost executor costs a round at most. Joins key on nodes; a hub's partition is
    split by Spark's skew join. The rounds grow with the logarithm of the longest path.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = stored(edges.where("u is not null and v is not null and u <> v").select(u.alias("u"), v.alias("v")).distinct())
    print_of = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    mark = print_of(now)
    while mark["n"]:
        then = stored(_stars(now))
        drop_stored(now)
        now, before, mark = then, mark, print_of(then)
        if mark == before:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
