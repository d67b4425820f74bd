"""Connected components of a link table, by alternating large and small stars.

Every round is a pair of aggregations and joins over the links, written to the shared folder, so a
lost executor costs one round at most. No vertex's neighbours are ever gathered in one row, and the
links of a vertex with very many neighbours can be read by several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.sources.tables import stage

ROUNDS = 60


def component_of(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Links to itself, repeated links and links with a null end add nothing. A node without links to
    another node does not occur in the result.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(
        links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        "links",
    )
    state = _state(now)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        now = stage(_small_star(_large_star(now)), "links")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # All that is left are stars around the smallest nodes.
    return now.select(b.alias("node"), a.alias("component")).union(
        now.select(a.alias("node"), a.alias("component")).distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour or itself."""
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("a"))
    return ends.where("v > u").join(low, "u").select("a", F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the smallest of them."""
    low = links.groupBy("b").agg(F.min("a").alias("low"))
    moved = links.join(low, "b").where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("low").alias("a"), "b")).distinct()


def _state(links: DataFrame) -> tuple:
    """Number of links and a sum of their hashes: equal before and after a round when nothing moved."""
    mixed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())
