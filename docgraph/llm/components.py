"""Connected components of an edge table by alternating large and small stars.

Every step is a minimum per node, combined map-side and stored, and a join back of
two stored tables, which adaptive execution may split where a hub has very many
edges.  A round's tables are deleted when the next one is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, save


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to (node, root): each node that has an edge, with the least node it reaches."""
    now = save(_ordered(edges), "edges")
    seen = _state(now)
    while seen[0]:
        before, now = now, _small_star(_large_star(now))
        discard(before)
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    out = save(_ordered(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))), "large-star")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    least = save(edges.groupBy("b").agg(F.min("a").alias("m")), "star-least")
    out = save(_ordered(
        edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b"))
    ), "small-star")
    discard(least, edges)
    return out
