"""Connected components of a link table by alternating star contractions, each pass a Spark join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.base import materialize

MAX_PASSES = 60
#: Links of one node that a task takes; nodes with more are hubs. The second figure bounds the hubs that are broadcast.
HUB, MOST_HUBS = 1 << 20, 1 << 17


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _around(edges: DataFrame, by: str, low: DataFrame, n: int) -> DataFrame:
    """edges with m, the row of low: (hub, m, degree) for their node `by`.

    The links of a hub would all meet in one task. There are fewer than 2 * n / HUB of them, and with HUB in proportion
    to n no more than MOST_HUBS, so their rows are broadcast; all other nodes are joined by key.
    """
    most = max(HUB, 2 * n // MOST_HUBS)
    if n <= most:
        return edges.join(low.drop("degree"), edges[by] == low["hub"])
    low = materialize(low, "low")
    hubs, others = F.broadcast(low.where(F.col("degree") > most).drop("degree")), low.where(F.col("degree") <= most).drop("degree")
    return edges.join(hubs, edges[by] == hubs["hub"]).unionByName(edges.join(hubs, edges[by] == hubs["hub"], "left_anti").join(others, edges[by] == others["hub"]))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected links of long nodes -> (node, component), component the smallest node reachable.

    Nodes without links don't appear; links with a null end or of a node with itself count for nothing, repeated ones
    once. Each pass points every node's larger neighbours, then its smaller ones, at the smallest node around; minima
    are pre-aggregated before the shuffle, and hubs joined by broadcast. Passes grow with the logarithm of the longest
    chain. No links give an empty table.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "links")
    mark = _mark(edges)
    for _ in range(MAX_PASSES):
        if not mark[0]:
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("hub"), F.least("a", "m").alias("m"), "degree")
        # a larger neighbour of the hub points at the smallest node around the hub
        large = _around(edges, "b", low, mark[0]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).withColumnRenamed("a", "hub")
        # the smaller neighbours of a hub, and the hub itself, point at the smallest of them
        small = _around(large, "a", low, mark[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialize(small.where("a <> b").distinct(), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component")).union(edges.select("b", "b").distinct())
