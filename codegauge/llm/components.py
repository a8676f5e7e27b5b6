"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.common import remove, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, or to itself if it is smaller."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of each node that has an edge; component: the smallest node that can be reached.

    edges: columns u, v. Self-links and repeated edges are ignored; no edges give no rows. Each round is written
    to the shared folder; nothing but a count and a checksum comes to the driver.
    """
    state = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or now[0] == 0:
            break
        new = written(small_star(large_star(state)), name)
        remove(state.sparkSession, state.at)
        state, before = new, now
    pairs = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
