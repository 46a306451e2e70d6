"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import store
from helixlake.stored import discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself. Edges have a < b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.least("a", "m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    onto = edges.join(least, "b").select("a", "b", "m")
    stay = F.struct(F.col("m").alias("a"), "b")
    move = F.struct(F.col("m").alias("a"), F.col("a").alias("b"))
    moved = onto.select(F.explode(F.when(F.col("a") > F.col("m"), F.array(stay, move)).otherwise(F.array(stay))).alias("e"))
    return moved.select("e.a", "e.b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, on which nothing hangs that isn't its least: nothing moves any more."""
    roles = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    roles = roles.union(edges.select(F.col("a").alias("node"), F.lit(0), F.lit(1)))
    counts = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return counts.where("below > 1 or (below = 1 and above = 1)").isEmpty()


def connected_components(edges: DataFrame, label: str = "components", rounds: int = 40) -> DataFrame:
    """(node, component): the least node that each node reaches. Edges (a, b) of integers; loops, repeated edges
    and nulls do no harm; a node without edges has no row. Each round is stored, so lineage
    stays short. Minima are combined before they are shuffled; in the joins with them a node's edges, of two integers each,
    pass through one task, since adaptive execution doesn't split a join whose other side is an aggregate.
    """
    found = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    for _ in range(rounds):
        if _stars(found):
            break
        before, found = found, store(_small_star(_large_star(found)), label)
        discard(edges.sparkSession, before.stored_at)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return found.select(F.col("b").alias("node"), F.col("a").alias("component")).union(found.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
