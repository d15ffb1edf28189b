"""Connected components by alternating large and small stars over an edge table, with a durable table each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.runtime import durable

MOST_ROUNDS = 60
#: Edges up to which the table of all nodes' least neighbours is broadcast (some 16 bytes each). Beyond, only nodes with more
#: than 1/SHARE of all edges are, of which there are 2 * SHARE at most; so no task gets a larger part of the edges for one node.
BROADCAST_EDGES, SHARE = 300_000, 1000


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n), n being how many rows of u there are."""
    if edges <= BROADCAST_EDGES:
        return rows.join(F.broadcast(least.drop("n")), "u")
    least = durable(least)
    hot = F.broadcast(least.filter(F.col("n") * SHARE > edges).select("u", "m"))
    cold = least.filter(F.col("n") * SHARE <= edges).select("u", "m")
    return rows.join(hot, "u").unionByName(rows.join(hot, "u", "left_anti").join(cold, "u"))


def _stars(pairs: DataFrame, large: bool, edges: int) -> DataFrame:
    """pairs are edges (a, b) with a < b. Each node sends its neighbours (the larger, or else the smaller ones) to its least neighbour."""
    n = F.count(F.lit(1)).alias("n")
    if large:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), n).select("u", F.least("u", "m").alias("m"), "n")
        out = _with_least(both.filter("v > u"), least, edges).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), n)
        moved = _with_least(down, least, edges)
        out = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b: long), component being the least node that it reaches.

    Self-loops and repeated edges do no harm; an empty table gives an empty one.
    """
    current = durable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = state(current)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        # A large star has no more edges than it began with.
        current = durable(_stars(_stars(current, True, seen[0]), False, seen[0]))
        if (now := state(current)) == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
