"""Connected components of an edge table, by alternating large and small stars.

Every round takes the least neighbour of each node by a partially aggregated groupBy, writes that
small table, and joins it back to the edges: a hub's edges are a splittable side of that join.
Edges are staged in the shared folder, never collected; superseded rounds are deleted.  The number
of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _least(edges: DataFrame) -> DataFrame:
    """edges with m, the least b of each a; the table of m is written, so that the join deals out
    both sides anew and adaptive execution can split a hub's edges."""
    least = common.staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    return edges.join(least.hint("merge"), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _least(down).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return moved.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges (a, b)."""
    edges = common.staged(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        large = common.staged(_large_star(edges), "edges")
        common.discard(edges)
        edges = common.staged(_small_star(large), "edges")
        common.discard(large)
        was, mark = mark, _mark(edges)
        if mark == was:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
