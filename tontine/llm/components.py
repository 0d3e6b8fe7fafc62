"""Connected components by alternating star steps; every label is the smallest member of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tontine.sources.shared import spool

#: Every pair of steps at least halves the depth of the deepest tree, so this is out of reach for any real input.
MOST_ROUNDS = 60


class NoConvergence(RuntimeError):
    """The star steps have not settled."""


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node around it.

    The smallest neighbour is a map-side aggregate that is joined back, so a hub is never gathered in one row.
    """
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``; loops and repeats do no harm).

    A star forest comes out of the alternating steps; each round is written to the shared folder, so lineage stays short
    and a lost executor costs one round at most.
    """
    stars = spool(edges.filter("a <> b").select("a", "b").distinct(), "stars")
    before = None
    for _ in range(MOST_ROUNDS):
        stars = spool(_small_star(_large_star(stars)), "stars")
        # Both steps keep the components; once a round changes nothing the edges are stars.
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return leaves.union(stars.select(F.col("b"), F.col("b")).distinct())
        before = now
    raise NoConvergence(f"no star forest after {MOST_ROUNDS} rounds")
