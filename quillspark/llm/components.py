"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.frames import BROADCAST_ROWS, cut

#: A node with more edges than this is a hub: its minimum goes to the edges, not its edges to one task.
HUB_EDGES = 256


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), 2 * n_edges)
    hubs = least.filter(F.col("n") > HUB_EDGES)
    if not 0 < hubs.count() <= BROADCAST_ROWS:
        return _moved(both, least)
    of_hubs = both.join(F.broadcast(hubs.select("u")), "u", "left_semi")
    others = both.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return _moved(of_hubs, F.broadcast(hubs)).unionByName(_moved(others, least.filter(F.col("n") <= HUB_EDGES)))


def _moved(both: DataFrame, least: DataFrame) -> DataFrame:
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node that can be reached.

    edges is read twice. Loops and repeated edges do no harm; an empty table gives an empty result. Minima are combined before each
    shuffle, so a node with very many edges costs one row per map task there. Each round is checkpointed.
    """
    n = edges.count()
    state = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n)
    sign = None
    while True:
        now = state.agg(F.count("*"), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            break
        sign = tuple(now)
        state = cut(_small_star(_large_star(state, n).distinct()).distinct(), n)
    nodes = state.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
