"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step is one shuffle of the edges with a map-side minimum, so a hub node costs a row per map task and not a list; the
minima are written before they are joined back, which lets Spark split the edges of a hub.
The number of rounds is logarithmic in the number of nodes; the edges of each round go to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut_lineage

#: Rounds after which the search gives up; 2^60 nodes need fewer.
MAX_ROUNDS = 64
#: Edges that a task takes at least, where there are so many.
EDGES_OF_TASK = 200_000


def _star(edges: DataFrame, parts: int) -> DataFrame:
    """Link what ``edges`` (from, to) pairs with each ``from`` to the least of its neighbours and itself."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(parts)
    return edges.join(cut_lineage(least), "a").coalesce(parts)  # of two tables, so that Spark can split the edges of a hub or broadcast few


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
    return _star(both, parts).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hooked = _star(down, parts)
    both = hooked.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
    return both.where("a <> b").distinct().coalesce(parts)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node that can be reached.

    Loops and repeated links are fine; links with a null end are ignored; no links give no rows.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    edges = cut_lineage(edges)
    before = _mark(edges)
    parts = before[0] // EDGES_OF_TASK + 1  # few edges need few tasks; more than a shuffle has make no difference
    edges = edges.coalesce(parts)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = cut_lineage(_small_star(cut_lineage(_large_star(edges, parts)), parts))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component")).distinct()
