"""Connected components of an edge table, by alternating large-star and small-star steps (a logarithmic number of joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import written


def _with(rows: DataFrame, hot: DataFrame | None, value) -> DataFrame:
    """rows (a, b) with m, the aggregate `value` of their a. Those of hot nodes (fewer than common.HOT) aren't shuffled."""

    def least(part: DataFrame) -> DataFrame:
        return part.groupBy("a").agg(value.alias("m"))

    if hot is None:
        return rows.join(least(rows), "a")
    cold, warm = (rows.join(F.broadcast(hot), "a", how) for how in ("left_anti", "left_semi"))
    return cold.join(least(cold), "a").unionByName(warm.join(F.broadcast(least(warm)), "a"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node of edges (a, b: long).

    Each round links every larger neighbour of a node to its smallest one, then the node and its smaller neighbours to the
    smallest; both keep connectivity, and the edges end as stars. Rounds go on until the edge set is the same. A node with more than
    a 1,000th of all ends of links is hot: what it needs to know is broadcast to its links, which stay where they are.
    """
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if not state[0] or tuple(state) == seen:
            return links.select(F.col("a").alias("node"),
                F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = tuple(state)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        most = max(common.LEAST_HOT, 2 * state[0] // common.HOT)
        hot = written(both.groupBy("a").count().filter(F.col("count") > most).select("a"), "hot") if 2 * state[0] > most else None
        large = _with(both, hot, F.least(F.min("b"), F.first("a")))
        large = large.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = _with(large, hot, F.min("b"))  # as many links at most as in `both`
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = written(small.filter("a <> b").distinct(), "links")
    raise RuntimeError("components: no end of rounds")
