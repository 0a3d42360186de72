"""Directed graphs as edge tables: reachability, strong components, their condensation, and the levels of an acyclic graph.

A graph falls into parts that no edge leaves. Parts of a bounded size are worked off in tasks, many in each; larger ones by rounds of joins over their edges, so that no
part need fit a task.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from latticework.functions.durable import Growing, discard, written, written_at
from latticework.functions.hubs import with_hubs_apart
from latticework.operators.components import connected_components, joined_sets
from latticework.operators.matching import once


def _clean(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return e.where("src is not null and dst is not null and src <> dst")


def _all_nodes(e: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """``(node)`` of the ends of ``e`` and of ``nodes``, some more than once."""
    ends = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(F.col("node").cast("long").alias("node")).where("node is not null"))
    return ends


#: A part with more nodes is worked off by joins; a task is given about as many edges of smaller ones.
PART, A_TASK = 2**21, 100_000


def _split(e: DataFrame, parts: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """``e`` in parts of at most ``limit`` nodes, with a ``task`` that holds its parts whole, and the rest of it."""
    parts = weak_components(e).withColumnRenamed("component", "part") if parts is None else parts.select("node", "part")
    large = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("part")
    own = written(e.join(parts.withColumnRenamed("node", "src"), "src").join(large.withColumn("large", F.lit(True)), "part", "left"))
    task = F.pmod(F.xxhash64("part"), F.lit(max(1, own.count() // A_TASK)))
    return own.where("large is null").select("src", "dst", task.alias("task")), own.where("large").select("src", "dst").distinct()


def _compact(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of some edges, and for the i-th node the numbers ``heads[starts[i]:starts[i + 1]]`` of those it leads to; and all tails."""
    src, dst = own["src"].to_numpy(), own["dst"].to_numpy()
    nodes = once(np.concatenate([src, dst]))
    tails, heads = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    order = np.argsort(tails, kind="stable")
    return nodes, np.searchsorted(tails[order], np.arange(len(nodes) + 1)), heads[order], tails[order]


def _on_cycles(starts: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Whether each node is left when those without edges in or without edges out go, again and again."""
    n, left = len(starts) - 1, np.ones(len(starts) - 1, dtype=bool)
    order = np.argsort(heads, kind="stable")
    ways = [(starts, heads), (np.searchsorted(heads[order], np.arange(n + 1)), tails[order])]
    degrees = [np.diff(ways[1][0]), np.diff(ways[0][0])]
    now = np.flatnonzero((degrees[0] == 0) | (degrees[1] == 0))
    while len(now):
        left[now] = False
        told = []
        for (first, other), degree in zip(ways, degrees):
            sizes = first[now + 1] - first[now]
            ends = other[np.repeat(first[now] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            np.subtract.at(degree, ends, 1)
            told.append(ends)
        told = once(np.concatenate(told))
        now = told[left[told] & ((degrees[0][told] == 0) | (degrees[1][told] == 0))]
    return left


def tight_sets(own: pd.DataFrame) -> pd.DataFrame:
    """``(node, component)`` of the ends of ``own(src, dst)``, by one depth-first walk that closes a set when it leaves its first node."""
    nodes, starts, heads, tails = _compact(own)
    inner = np.flatnonzero(_on_cycles(starts, heads, tails))
    if not len(inner):
        return pd.DataFrame({"node": nodes, "component": nodes})
    # Only nodes that may lie on cycles are walked, by their numbers among themselves, in lists of numbers without objects.
    at = np.full(len(nodes), -1)
    at[inner] = np.arange(len(inner))
    both = (at[tails] >= 0) & (at[heads] >= 0)
    tails, heads, n = at[tails[both]], array("q", at[heads[both]].tobytes()), len(inner)
    first = array("q", np.searchsorted(tails, np.arange(n + 1)).tobytes())
    seen, low, component, next_, count = array("q", [-1]) * n, array("q", [0]) * n, array("q", [-1]) * n, first[:-1], 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        walk, open_ = [root], [root]
        seen[root] = low[root] = count
        count += 1
        while walk:
            a = walk[-1]
            if next_[a] < first[a + 1]:
                b = heads[next_[a]]
                next_[a] += 1
                if seen[b] < 0:
                    seen[b] = low[b] = count
                    count += 1
                    walk.append(b)
                    open_.append(b)
                elif component[b] < 0:
                    low[a] = min(low[a], seen[b])
                continue
            walk.pop()
            if walk:
                low[walk[-1]] = min(low[walk[-1]], low[a])
            if low[a] == seen[a]:
                whole = [open_.pop()]
                while whole[-1] != a:
                    whole.append(open_.pop())
                least = min(whole)
                for b in whole:
                    component[b] = least
    found = nodes.copy()
    found[inner] = nodes[inner[np.array(component, dtype=int)]]
    return pd.DataFrame({"node": nodes, "component": found})


def level_sets(own: pd.DataFrame) -> pd.DataFrame:
    """``(node, level)`` of the ends of ``own(src, dst)``; -1 on cycles and behind them."""
    nodes, starts, heads, _ = _compact(own)
    waiting, level, now, k = np.bincount(heads, minlength=len(nodes)), np.full(len(nodes), -1), None, 0
    now = np.flatnonzero(waiting == 0)
    while len(now):
        level[now] = k
        sizes = starts[now + 1] - starts[now]
        told = heads[np.repeat(starts[now] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
        np.subtract.at(waiting, told, 1)
        told = once(told)
        now, k = told[waiting[told] == 0], k + 1
    return pd.DataFrame({"node": nodes, "level": level.astype("int32")})


def spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, x)`` for each of ``nodes(node, x)``: the least ``x`` among the nodes that reach it along ``edges(src, dst)``, itself included.

    Null is no value. Only nodes whose value fell in the last round send, so a round shuffles the edges that leave those; there are as many rounds as steps on the longest way of a
    value. An end of an edge that isn't among ``nodes`` gets and sends nothing.
    """
    table, at = written_at(nodes.select("node", "x", F.col("x").isNotNull().alias("fresh")))
    better = F.coalesce(F.col("m") < F.col("x"), F.col("m").isNotNull())
    while True:
        sent = edges.join(table.where("fresh").select(F.col("node").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("x").alias("m"))
        seen = Observation()
        after = table.join(sent, "node", "left").select("node", F.when(better, F.col("m")).otherwise(F.col("x")).alias("x"), better.alias("fresh"))
        after, new = written_at(after.observe(seen, F.count_if("fresh").alias("n")))
        discard(nodes.sparkSession, [at])
        table, at = after, new
        if not seen.get["n"]:
            return table.select("node", "x")


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, parts: DataFrame | None = None, limit: int = PART) -> DataFrame:
    """``(node, component)`` of every end of ``edges(src, dst)`` and every row of ``nodes(node)``; component is the least node of its strong component.

    Self-loops, repeated edges and null ends are ignored; empty tables give an empty result. ``parts(node, part)`` is a labelling of all nodes that no edge crosses, the weak components
    where it isn't given. Parts of over ``limit`` nodes go by rounds. A round trims nodes without edges in or out, gives each other one the
    least colour (a hash of the node, new each round) that reaches it, and takes for each colour the nodes from which its own node can be reached: these are one component.
    Edges between colours and at found nodes go. Hashed colours cut long acyclic parts into pieces, so the number of rounds grows with the logarithm of the
    number of nodes, in each of which colours go as many steps as the longest way inside a piece.
    """
    spark = edges.sparkSession
    small, live = _split(_clean(edges), parts, limit)
    named = small.groupBy("task").applyInPandas(tight_sets, "node long, component long")
    if not live.isEmpty():
        named = named.unionByName(_by_rounds(spark, live))
    return _least_of(named, _all_nodes(live, nodes))


def _least_of(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``named(node, component)``, and each other one of ``nodes`` by itself: a component is never greater than its nodes, so the least of all rows of a node is its own."""
    return named.unionByName(nodes.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _by_rounds(spark: SparkSession, live: DataFrame) -> DataFrame:
    """``(node, component)`` of the strong components of two and more nodes of ``live(src, dst)``."""
    at, found, seed = None, Growing(spark, "node long, root long"), 0
    while True:
        both = live.select(F.col("src").alias("node")).distinct().intersect(live.select(F.col("dst").alias("node")).distinct())
        inner, inner_at = written_at(both)
        ends = lambda c: inner.select(F.col("node").alias(c))  # noqa: B023, E731
        live, live_at = written_at(live.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi"))
        discard(spark, [at] if at else [])
        if live.isEmpty():
            break
        colours = spread(inner.select("node", F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("r")).alias("x")), live)
        colour = lambda c, x: colours.select(F.col("node").alias(c), F.col("x.r").alias(x))  # noqa: B023, E731
        inside, inside_at = written_at(live.join(colour("src", "a"), "src").join(colour("dst", "b"), "dst").where("a = b").select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        caught = spread(colours.select("node", F.when(F.col("x.r") == F.col("node"), F.col("node")).alias("x")), back).where("x is not null").select("node", F.col("x").alias("root"))
        found.add(caught)
        gone = lambda c: caught.select(F.col("node").alias(c))  # noqa: B023, E731
        rest, rest_at = written_at(inside.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti"))
        discard(spark, [inner_at, live_at, inside_at])
        live, at, seed = rest, rest_at, seed + 1
    caught = found.table()
    least = caught.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return with_hubs_apart(caught, least, "root", "n", caught.count()).select("node", "component")


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(src, dst)``: the distinct edges of ``edges(src, dst)`` between different ones of ``components(node, component)``, an acyclic graph where these are strong components."""
    own = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    both = _clean(edges).join(own("src"), "src").join(own("dst"), "dst")
    return both.where("src_component <> dst_component").select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).distinct()


def levels(dag: DataFrame, nodes: DataFrame | None = None, parts: DataFrame | None = None, limit: int = PART) -> DataFrame:
    """``(node, level)``: the length of the longest way to a node of an acyclic graph ``dag(src, dst)``, 0 for nodes without edges in.

    ``parts`` and ``limit`` are those of ``strong_components``. In large parts each round takes the nodes that wait for nothing any more; their messages, summed for each receiver, lower the number of edges that it waits for. A round reads and
    writes only nodes that still wait. A cycle raises ValueError; self-loops, repeated edges and null ends are ignored.
    """
    small, large = _split(_clean(dag), parts, limit)
    near = written(small.groupBy("task").applyInPandas(level_sets, "node long, level int"))
    if stuck := near.where("level < 0").count():
        raise ValueError(f"not acyclic: {stuck} nodes lie on cycles or behind them")
    found = near if large.isEmpty() else near.unionByName(_levels_by_rounds(dag.sparkSession, large))
    return found.unionByName(_all_nodes(large, nodes).select("node", F.lit(0).alias("level"))).groupBy("node").agg(F.max("level").alias("level"))


def _levels_by_rounds(spark: SparkSession, e: DataFrame) -> DataFrame:
    """``(node, level)`` of the ends of the acyclic ``e(src, dst)``."""
    waits = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("waiting"))
    start = _all_nodes(e, None).distinct().join(waits, "node", "left").select("node", F.coalesce("waiting", F.lit(0).cast("long")).alias("waiting"))
    seen = Observation()
    table, at = written_at(start.observe(seen, F.count_if(F.col("waiting") == 0).alias("free"), F.count(F.lit(1)).alias("n")))
    out, level, (free, n) = Growing(spark, "node long, level int"), 0, (seen.get["free"], seen.get["n"])
    while free:
        now = table.where("waiting = 0")
        out.add(now.select("node", F.lit(level).alias("level")))
        n -= free
        if not n:
            break
        told = e.join(now.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("k"))
        rest = table.where("waiting > 0").join(told, "node", "left").select("node", (F.col("waiting") - F.coalesce("k", F.lit(0))).alias("waiting"))
        seen = Observation()
        after, new = written_at(rest.observe(seen, F.count_if(F.col("waiting") == 0).alias("free")))
        discard(spark, [at])
        table, at, free, level = after, new, seen.get["free"], level + 1
    if n:
        raise ValueError(f"not acyclic: {n} nodes lie on cycles or behind them")
    return out.table()


def weak_components(edges: DataFrame, nodes: DataFrame | None = None, parts: DataFrame | None = None, limit: int = PART) -> DataFrame:
    """``(node, component)``: connected sets with directions ignored, named by their least node; nodes without edges are sets of their own.

    ``parts`` and ``limit`` are those of ``strong_components``; without ``parts`` all goes by rounds.
    """
    e = _clean(edges)
    if parts is None:
        return _least_of(connected_components(e), _all_nodes(e, nodes))
    small, large = _split(e, parts, limit)
    found = small.groupBy("task").applyInPandas(joined_sets, "node long, component long")
    found = found if large.isEmpty() else found.unionByName(connected_components(large))
    return _least_of(found, _all_nodes(large, nodes))
