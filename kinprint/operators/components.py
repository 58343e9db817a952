"""Connected components by alternating large-star and small-star steps.

Published as "Connected Components in MapReduce and Beyond" (Kiveris et al., 2014). Edges
stay a distributed table; each round is aggregations and equi-joins, so a hub is
pre-aggregated before the shuffle and its join side can be split. Rounds end when the edge
set stops changing, which takes a number of rounds logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.session import cut


def _state(edges: DataFrame):
    return edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
    ).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each larger neighbour of a node on the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str, v: str, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Edges with a null end or with equal ends, and repeated edges, change nothing. No edges
    give an empty table.
    """
    now = cut(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct()
    )
    state = _state(now)
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"no fixed point within {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())
