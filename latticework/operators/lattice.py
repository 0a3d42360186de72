"""Periodic square lattices as site tables: occupation, neighbours, local rules and clusters."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import discard, written, written_at
from latticework.functions.hubs import with_hubs_apart
from latticework.operators.components import connected_components, least_joined


def uniform(seed: Column, key: Column) -> Column:
    """A number in [0, 2^32) that depends on seed and key alone."""
    text = F.concat(seed.cast("string"), F.lit("-"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sites(keys: DataFrame, key: str, length: int, samples: int, density: float) -> DataFrame:
    """``(sample_id, site, x, y, occ)`` of ``samples`` lattices of ``length`` squared sites; ``keys`` gives the site numbers."""
    own = keys.select(F.col(key).cast("long").alias("site")).where(F.col("site") < length * length)
    own = own.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    occ = (uniform(F.col("sample_id"), F.col("site")) < int(density * 2**32)).cast("int")
    return own.select("sample_id", "site", (F.col("site") % length).alias("x"), F.expr(f"site div {length}").alias("y"), occ.alias("occ"))


def neighbour_numbers(length: int) -> Column:
    """The four neighbours of a site with periodic sides."""
    at = lambda x, y: F.expr(f"pmod({y}, {length}) * {length} + pmod({x}, {length})")
    return F.array(at("x + 1", "y"), at("x - 1", "y"), at("x", "y + 1"), at("x", "y - 1"))


def grid_neighbours(length: int, dims: int = 2) -> Column:
    """The ``2 * dims`` neighbours of ``site`` in ``dims`` dimensions with periodic sides, each once."""
    steps = [(f"(site div {length**d}) % {length}", length**d) for d in range(dims)]
    return F.array_distinct(F.array(*[F.expr(f"site + (pmod({at} {sign} 1, {length}) - {at}) * {stride}") for at, stride in steps for sign in "+-"]))


def parity(length: int, dims: int = 2) -> Column:
    """Side of the checkerboard of ``site``."""
    return F.expr("(" + " + ".join(f"(site div {length**d}) % {length}" for d in range(dims)) + ") % 2")


def bonds(table: DataFrame, length: int) -> DataFrame:
    """``(sample_id, site, nb)``: each site with each of its distinct neighbours."""
    return table.select("sample_id", "site", F.explode(F.array_distinct(neighbour_numbers(length))).alias("nb")).where("site <> nb")


def neighbour_sum(table: DataFrame, flag: str, length: int, name: str) -> DataFrame:
    """``table`` with ``name``, the number of neighbours whose 0/1 column ``flag`` is set.

    Set sites send themselves to their neighbours, so that only those are shuffled, summed on the map side.
    """
    sent = table.where(F.col(flag) == 1).select("sample_id", F.explode(F.array_distinct(neighbour_numbers(length))).alias("site"))
    sums = sent.groupBy("sample_id", "site").agg(F.count(F.lit(1)).alias(name))
    return table.join(sums, ["sample_id", "site"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def local_rules(table: DataFrame, length: int) -> DataFrame:
    """Adds ``core`` (occupied with an occupied neighbour) and ``active`` (no neighbour in the core)."""
    one = neighbour_sum(table, "occ", length, "n_occ").withColumn("core", ((F.col("occ") == 1) & (F.col("n_occ") > 0)).cast("int"))
    two = neighbour_sum(one, "core", length, "n_core")
    return two.withColumn("active", (F.col("n_core") == 0).cast("int"))


def k_core(own: DataFrame, length: int, k: int) -> DataFrame:
    """The sites of ``own(sample_id, site, x, y)`` that are left when those with fewer than ``k`` neighbours in it go, again and again.

    Each round is one shuffle of the sites that are left, written so that the next one starts from it; rounds are as many as the longest path of removals.
    """
    left, at = written_at(own.select("sample_id", "site", "x", "y"))
    before = left.count()
    while before:
        sent = left.select("sample_id", F.explode(F.array_distinct(neighbour_numbers(length))).alias("to"), "site").where("to <> site")
        rich = sent.groupBy("sample_id", F.col("to").alias("site")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("sample_id", "site")
        fewer, new = written_at(left.join(rich, ["sample_id", "site"], "left_semi").select("sample_id", "site", "x", "y"))
        discard(own.sparkSession, [at])
        left, at, after = fewer, new, fewer.count()
        if after == before:
            break
        before = after
    return left


def clusters(table: DataFrame, flag: str, length: int, tile: int = 256) -> DataFrame:
    """``(sample_id, site, cluster)`` of the sites with ``flag`` set; cluster is the least site of its connected set.

    Sites are joined inside squares of ``tile`` by ``tile`` sites, a task's bounded group each; only the sets that bonds between two squares tie together go through rounds.
    """
    own = table.where(F.col(flag) == 1).select("sample_id", "site", "x", "y")
    square = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "xy"]

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        site = np.sort(rows["site"].to_numpy())
        x, y = site % length, site // length
        ends = []
        for step, inside in ((1, x % tile != tile - 1), (length, y % tile != tile - 1)):
            inside &= (x if step == 1 else y) != length - 1
            a = np.flatnonzero(inside)
            b = np.searchsorted(site, site[a] + step)
            met = b < len(site)
            met[met] = site[b[met]] == site[a[met]] + step
            ends.append((a[met], b[met]))
        least = least_joined(len(site), *(np.concatenate(e) for e in zip(*ends)))
        return pd.DataFrame({"sample_id": rows["sample_id"].iloc[0], "site": site, "label": site[least]})

    kind = dict(own.dtypes)["sample_id"]
    near = written(own.select("*", *square).groupBy("sample_id", "tx", "ty").applyInPandas(join, f"sample_id {kind}, site long, label long"))
    xy = near.select("*", (F.col("site") % length).alias("x"), F.expr(f"site div {length}").alias("y"))
    border = " or ".join(f"{c} % {tile} in (0, {tile - 1}) or {c} = {length - 1}" for c in "xy")
    rim = written(xy.where(border))
    size = length * length
    node = lambda c: (F.col("sample_id") * size + F.col(c)).cast("long")
    ties = bonds(rim, length).where("site < nb").join(rim.select("sample_id", F.col("site").alias("nb"), F.col("label").alias("label2")), ["sample_id", "nb"])
    ties = ties.join(rim.select("sample_id", "site", "label"), ["sample_id", "site"]).where("label <> label2")
    found = connected_components(ties.select(node("label").alias("src"), node("label2").alias("dst")), in_task=500_000)
    found = found.select(F.expr(f"cast(node div {size} as {kind})").alias("sample_id"), (F.col("node") % size).alias("label"), (F.col("component") % size).alias("cluster"))
    return near.join(found, ["sample_id", "label"], "left").select("sample_id", "site", F.coalesce("cluster", "label").alias("cluster"))


def bipartite_graph(own: DataFrame, length: int, limit: int = 2**21) -> tuple[DataFrame, DataFrame]:
    """``(node, side, cluster, piece)`` and ``(u, v)``: the sites of ``own(sample_id, site, cluster)`` on a lattice of even ``length``, and their bonds from side 0 of the checkerboard to side 1.

    A node is ``sample_id * length^2 + site``; a cluster with over ``limit`` sites is cut into squares of that many, its pieces.
    """
    if length % 2:
        raise ValueError("a periodic lattice of odd length has no two sides")
    size, width = length * length, max(1, isqrt(limit))
    node = (F.col("sample_id").cast("long") * size + F.col("site")).alias("node")
    xy = own.select("sample_id", "site", (F.col("site") % length).alias("x"), F.expr(f"site div {length}").alias("y"), node, parity(length).cast("int").alias("side"), (F.col("sample_id").cast("long") * size + F.col("cluster")).alias("cluster"))
    xy = written(xy)
    sizes = xy.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    cut = with_hubs_apart(xy, sizes.withColumn("large", F.col("n") > limit), "cluster", "n", xy.count())
    tile = F.xxhash64("cluster", F.floor(F.col("x") / width), F.floor(F.col("y") / width))
    vertices = cut.select("node", "side", "cluster", F.when(F.col("large"), tile).otherwise(F.col("cluster")).alias("piece"))
    ends = xy.select("sample_id", F.col("site").alias("nb"), F.col("node").alias("v"))
    edges = bonds(xy.where("side = 0"), length).join(ends, ["sample_id", "nb"])
    return vertices, edges.select((F.col("sample_id").cast("long") * size + F.col("site")).alias("u"), "v")


def remaining(table: DataFrame, length: int, k: int) -> DataFrame:
    """``table(sample_id, site, x, y, occ)`` with ``remain``: 1 for the sites that are neither blocked nor cut off and lie in their sample's largest such cluster.

    Blocked sites have ``k`` or more occupied neighbours; of the others, those go of which no neighbour stays (a neighbour that is blocked doesn't count); of equally large clusters the one with
    the least site stays.
    """
    one = neighbour_sum(table, "occ", length, "_near").withColumn("_open", (F.col("_near") < k).cast("int"))
    two = written(neighbour_sum(one, "_open", length, "_left").withColumn("_open", F.when(F.col("_left") > 0, F.col("_open")).otherwise(0)))
    found = written(clusters(two, "_open", length))
    sizes = found.groupBy("sample_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("sample_id").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"))
    inside = found.join(best, ["sample_id", "cluster"], "left_semi").select("sample_id", "site", F.lit(1).alias("remain"))
    return two.select(*table.columns).join(inside, ["sample_id", "site"], "left").withColumn("remain", F.coalesce("remain", F.lit(0)))
