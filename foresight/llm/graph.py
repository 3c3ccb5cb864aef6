"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresight.llm.workspace import Workspace


def _large_star(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = space.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the smallest of them."""
    least = space.put(edges.groupBy("a").agg(F.min("b").alias("m")), name)
    ties = edges.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ties.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, space: Workspace, label: str = "edges") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: comparable ids); root is the smallest id reachable.

    Each round writes its edges and compares a checksum with the round before; a star forest is the
    fixed point. Minima fold before their shuffle and are written, so that the joins that bring them
    back to the edges have a plain shuffle on both sides: AQE splits a hub's edges over many tasks.
    """
    ordered = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current, name, before, turn = space.put(ordered.distinct(), f"{label}-0"), f"{label}-0", None, 0
    while True:
        sums = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        mark = (sums["n"], sums["h"])
        if mark == before or mark[0] == 0:
            break
        before, turn = mark, turn + 1
        used = [name, *(f"{label}-{turn}-{x}" for x in ("least", "large", "lesser"))]
        large = space.put(_large_star(current, space, used[1]).distinct(), used[2])
        name = f"{label}-{turn}"
        current = space.put(_small_star(large, space, used[3]).distinct(), name)
        space.drop(*used)
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of links."""

    def __init__(self, size: int) -> None:
        import numpy as np

        self.np, self.parent = np, np.arange(size)

    def link(self, a, b) -> None:
        np, parent = self.np, self.parent
        while len(a):
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.parent = parent
