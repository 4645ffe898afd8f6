"""Connected components of a graph of pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.skew import HOT_ROWS, hot_list, skew_join
from vigil.session import Scratch

NEW, OLD = 1, 2  # a row of this round, of the round before


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Tie each vertex's larger (large) or not larger (small) neighbours to its smallest neighbour. 

    Degrees are counted with the smallest neighbours; only where some vertex is hot does the join look for hot keys.
    """
    if large:
        near = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = scratch.save(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), most=F.max("n"))
    if (scratch.watched(least, "most") or 0) >= HOT_ROWS:
        tied = skew_join(near, least.select("u", "m"), "u", "inner", hot_list(least, "u", "n"))
    else:
        tied = near.join(least.select("u", "m"), "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = scratch.save(out.where("a <> b").distinct())
    scratch.drop(least)
    return out


def components(pairs: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, component) with the smallest node of each component.  The number of edges never grows.

    A round is over when its edges are those of the round before: both sets are put together by edge in the same
    aggregate that makes edges distinct, and edges that only one of them has are counted.  Pairs with a null end are left
    out; a node paired only with itself is not listed.
    """
    edges = scratch.save(pairs.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        wide = _star(edges, True, scratch)
        made = _star(wide, False, scratch)
        both = made.withColumn("_in", F.lit(NEW)).unionByName(edges.withColumn("_in", F.lit(OLD))).groupBy("a", "b").agg(F.bit_or("_in").alias("_in"))
        following = scratch.save(both, F.col("_in") != OLD, ("_in",), changed=F.count_if(F.col("_in") != NEW + OLD))
        scratch.drop(edges, wide, made)
        edges = following
        if not scratch.watched(following, "changed"):
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
