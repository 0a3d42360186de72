"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from latticework.functions.durable import discard, written_at
from latticework.functions.hubs import with_hubs_apart
from latticework.operators.matching import once


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 of a small graph the least one that the edges ``a[i]``, ``b[i]`` join it to, itself included."""
    up = np.arange(n)
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (low == high).all():
            return up
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def _large_star(e: DataFrame, n: int) -> DataFrame:
    """Every neighbour above ``u`` is tied to the least of ``u`` and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return with_hubs_apart(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, n: int) -> DataFrame:
    """``u`` and every neighbour below it are tied to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = with_hubs_apart(e, least, "u", "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _ordered(e: DataFrame) -> DataFrame:
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _told(e: DataFrame) -> tuple[DataFrame, str, tuple]:
    """``e`` written, its folder, and its number of rows and a checksum, which the write itself takes."""
    seen = Observation()
    out, path = written_at(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return out, path, (seen.get["n"], seen.get["h"])


def joined_sets(own: pd.DataFrame) -> pd.DataFrame:
    """``(node, component)`` of the ends of a task's edges, the first two columns of ``own``."""
    src, dst = own.iloc[:, 0].to_numpy(), own.iloc[:, 1].to_numpy()
    nodes = once(np.concatenate([src, dst]))
    return pd.DataFrame({"node": nodes, "component": nodes[least_joined(len(nodes), np.searchsorted(nodes, src), np.searchsorted(nodes, dst))]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", in_task: int = 0) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another; component is its least node.

    Self-loops, repeated edges and null ends are ignored; an empty table gives an empty result. Each
    round contracts all nodes towards their least neighbour, so the number of rounds grows with the
    logarithm of the longest path; only counts and one checksum reach the driver. Nodes with a large share of the edges (the
    root of a large component has all its nodes as neighbours) are joined by a broadcast of a bounded number of them. A graph of integer nodes
    with at most ``in_task`` different edges, by their count, is joined in one task.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e, at, before = _told(_ordered(e))
    if 0 < before[0] <= in_task:
        return e.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(joined_sets, "node long, component long")
    while before[0]:
        large, large_at = written_at(_ordered(_large_star(e, before[0])))
        old = [at, large_at]
        e, at, after = _told(_ordered(_small_star(large, before[0])))
        discard(edges.sparkSession, old)
        if after == before:
            break
        before = after
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
