"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.storage import Stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _settled(edges: DataFrame) -> DataFrame:
    """The components of few edges between longs, found on the driver by smallest labels and pointer jumping."""
    found = edges.toArrow()
    nodes, at = np.unique(np.concatenate([found[c].to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        for a, b in ((u, v), (v, u)):
            np.minimum.at(low, label[a], label[b])
        while (low != low[low]).any():
            low = low[low]
        if (low == label).all():
            return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes[label]}))
        label = low


def connected_components(edges: DataFrame, on_driver: int = 0) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node of its component.

    ``edges`` has columns u and v of one orderable type. Self loops, repeated edges, both directions and nulls are allowed; nulls link
    nothing, and an empty table gives an empty result. A round takes two aggregations with map-side minima and two joins whose hot keys
    adaptive execution can split; no neighbour list is ever gathered. Rounds grow with the logarithm of the largest component.
    Up to ``on_driver`` distinct edges between longs are settled on the driver instead, by one job and not dozens.
    """
    now = Stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = _state(now.df)
    if 0 < state[0] <= on_driver:
        return _settled(now.df)
    while state[0]:
        following = Stored(_small_star(_large_star(now.df)), "edges", state[0])  # a round never adds edges
        now.drop()
        now, before, state = following, state, _state(following.df)
        if state == before:
            break
    members = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
