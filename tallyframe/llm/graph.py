"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum (combined before the shuffle) and a join back on the node; the number of
rounds is logarithmic in practice.  Nodes with more than a 10,000th of all edges, hubs, are so few that
their minima are broadcast, and their edges stay where they are; no task gathers more edges of one node
than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: At most so many hubs, and the least edges of one.
HUBS, HUB = 10_000, 64


def _with_least(rows: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """rows (a, b) and least (a, m, n) -> (a, b, m).  The n of all rows add up to `size`."""
    many = F.col("n") > max(HUB, size // HUBS)
    hubs = F.broadcast(least.where(many).select("a", "m"))  # under HUBS rows
    marked = rows.join(hubs, "a", "left")
    far = marked.where("m IS NULL").select("a", "b").join(least.where(~many).select("a", "m"), "a")
    return marked.where("m IS NOT NULL").unionByName(far)


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
    return _with_least(both, least, 2 * size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = _with_least(down, least, size).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a <> b, of any ordered type -> (a, b): each node but the smallest of its
    component, with that smallest node.  Nodes without edges don't appear."""
    edges = edges.select("a", "b")
    now = _summary(edges)
    while True:
        before = now
        starred = cut(_large_star(edges, now[0]))
        edges = cut(_small_star(starred, starred.count()))
        now = _summary(edges)
        if now == before:
            return edges
