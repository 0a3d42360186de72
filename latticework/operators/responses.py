"""What forcing one vertex does to a greatest independent set: a vertex of the set is forced out of it, any other one into it.

A matching is repaired, not found anew: each vertex that leaves opens its partner, and one augmenting search from there makes the matching greatest again.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.operators.matching import neighbours


def _closed(to: dict[int, int], near: dict[int, list[int]], w: int, gone: set[int], undo: dict[int, int | None]) -> None:
    """Match the open vertex ``w`` again by an augmenting path around ``gone``, if there is one."""
    by, queue = {}, deque([w])
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b in by or b in gone:
                continue
            by[b] = a
            c = to.get(b)
            if c is None:
                while True:  # hand partners on towards w
                    a = by[b]
                    before = to.get(a)
                    for x, y in ((a, b), (b, a)):
                        undo.setdefault(x, to.get(x))
                        to[x] = y
                    if a == w:
                        return
                    b = before
            queue.append(c)


class Reached:
    """The vertices that alternating ways from the unmatched vertices of side 0 reach, as trees: ``owner`` of each, and the vertices of each owner.

    The greatest independent set is the reached ones of side 0 and those of side 1 that aren't.
    """

    def __init__(self, open_: list[int], near: dict[int, list[int]], to: dict[int, int]):
        self.owner = {u: u for u in open_}
        self.trees = {u: [u] for u in open_}
        queue = deque(open_)
        while queue:
            u = queue.popleft()
            for b in near[u]:
                if b not in self.owner:
                    root, w = self.owner[u], to[b]
                    self.owner[b] = self.owner[w] = root
                    self.trees[root] += [b, w]
                    queue.append(w)


def response(x: int, near: dict[int, list[int]], side: dict[int, int], to: dict[int, int], reached: Reached) -> tuple[int, int]:
    """``(changed, shift)`` of forcing ``x``: the vertices whose place in the greatest independent set differs, and by how many the set is smaller.

    ``to`` is a greatest matching, and the same again afterwards. Only trees in which a partner changed are grown anew; all others still reach what they reached.
    """
    owner = reached.owner
    inside = (x in owner) == (side[x] == 0)
    gone, undo, opened = {x} if inside else {x, *near[x]}, {}, []
    for d in gone:
        w = to.get(d)
        if w is not None:
            undo |= {a: to.pop(a) for a in (d, w)}
            opened += [w] if w not in gone else []
    for w in opened:
        if w not in to:
            _closed(to, near, w, gone, undo)
    touched = {owner[a] for a in (*undo, *gone) if a in owner}
    stands = lambda a: a in owner and owner[a] not in touched
    cut = [a for root in touched for a in reached.trees[root]]
    zero = {a for a in (*undo, *touched) if side[a] == 0 and a not in to and a not in gone}
    one = {b for b in cut if side[b] == 1 and b not in gone and any(stands(u) for u in near[b])}
    queue = deque(zero)
    for b in one:
        u = to[b]
        if u not in zero and not stands(u):
            zero.add(u)
            queue.append(u)
    while queue:
        for b in near[queue.popleft()]:
            if b not in one and b not in gone and not stands(b):
                one.add(b)
                u = to[b]
                if u not in zero and not stands(u):
                    zero.add(u)
                    queue.append(u)
    for a, b in undo.items():
        if b is None:
            to.pop(a, None)
        else:
            to[a] = b
    before0, before1 = {a for a in cut if side[a] == 0}, {a for a in cut if side[a] == 1}
    one |= {d for d in gone if side[d] == 1}
    if not inside:
        (zero.add if side[x] == 0 else one.discard)(x)
    return len(zero ^ before0) + len(one ^ before1), len(before0) - len(zero) + len(one) - len(before1)


class Near(dict):
    """The neighbours of a node as a list, made from ``neighbours``' form when first asked for."""

    def __init__(self, starts: np.ndarray, heads: np.ndarray):
        self.starts, self.heads = starts, heads

    def __missing__(self, a: int) -> list[int]:
        self[a] = out = self.heads[self.starts[a] : self.starts[a + 1]].tolist()
        return out


def placed(x: int, state: int, near: dict[int, list[int]], side: dict[int, int], to: dict[int, int], reached: Reached) -> tuple[int, int]:
    """``response`` for a vertex with a known ``state`` (-1: undetermined), by shorter ways for side 1.

    One that is in all sets can be left open by a greatest matching that reaches the same, so it alone changes. An undetermined one can't: its partner and all that this reaches come in, as many as go.
    """
    if side[x] == 1 and state == 1:
        return 1, 1
    if side[x] == 0 or state != -1:
        return response(x, near, side, to, reached)
    gone, rows, owner = {x}, [to[x]], reached.owner
    for u in rows:
        for b in near[u]:
            if b not in gone and b not in owner:
                gone.add(b)
                rows.append(to[b])
    return len(gone) + len(rows), 0


def site_responses(solved: DataFrame, edges: DataFrame, a_task: int = 20_000) -> DataFrame:
    """``(node, cluster, mis, changed, shift)`` for every vertex of ``ground``'s result ``solved`` and its ``edges(u, v)``.

    A vertex is forced to the other state and the greatest independent set of the rest, by the same rule as ``mis``, is compared: ``changed`` vertices differ, it is smaller by ``shift``. Forcing acts inside
    one cluster alone. Clusters are dealt to tasks whole, small ones together; one with over ``a_task`` vertices is dealt several times, each with a range of its vertices to force, so
    a task holds a cluster, in arrays, and the work on it is shared out. Empty tables give an empty result.
    """
    kind = dict(solved.dtypes)["cluster"]
    sizes = solved.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    parts = F.floor((F.col("n") - 1) / a_task).cast("int") + 1
    small = F.pmod(F.xxhash64("cluster"), F.lit(max(1, solved.count() // a_task)))
    task = F.when(F.col("n") <= a_task, small).otherwise(-1 - F.xxhash64("cluster").bitwiseAND((1 << 62) - 1))
    own = solved.select("node", "side", "cluster", "mis", F.coalesce("partner", "node").alias("partner"), F.coalesce("state", F.lit(-1)).alias("state")).join(sizes, "cluster")
    own = written(own.select("node", "side", "cluster", "mis", "partner", "state", task.alias("task"), parts.alias("parts")))
    place = ["task", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", "cluster"]
    vertices = own.select(*place, F.col("node").alias("a"), F.col("partner").alias("b"), "side", "mis", "state")
    ends = edges.select("u", "v").join(own.select(F.col("node").alias("u"), "task", "parts", "cluster"), "u")
    ends = ends.select(*place, F.col("u").alias("a"), F.col("v").alias("b"), F.lit(-1).alias("side"), F.lit(0).alias("mis"), F.lit(0).alias("state"))

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        part, parts = int(own["part"].iloc[0]), int(own["parts"].iloc[0])
        a, b, side = (own[c].to_numpy() for c in ("a", "b", "side"))
        at = np.flatnonzero(side >= 0)
        at = at[np.argsort(a[at], kind="stable")]
        nodes, n = a[at], len(at)
        partner = np.searchsorted(nodes, b[at])
        cluster, mis, state = (own[c].to_numpy()[at] for c in ("cluster", "mis", "state"))
        u, v = np.searchsorted(nodes, a[side < 0]), np.minimum(np.searchsorted(nodes, b[side < 0]), n - 1)
        known = nodes[v] == b[side < 0]
        near = Near(*neighbours(n, u[known], v[known]))
        open_ = partner == np.arange(n)
        to = dict(zip(np.flatnonzero(~open_).tolist(), partner[~open_].tolist()))
        side = side[at].astype(np.int8).tobytes()
        reached = Reached([a for a in np.flatnonzero(open_).tolist() if side[a] == 0], near, to)
        mine = range(part * n // parts, (part + 1) * n // parts)
        found = np.array([placed(x, s, near, side, to, reached) for x, s in zip(mine, state[mine.start : mine.stop].tolist())], dtype=np.int64).reshape(-1, 2)
        here = slice(mine.start, mine.stop)
        return pd.DataFrame({"node": nodes[here], "cluster": cluster[here], "mis": mis[here], "changed": found[:, 0], "shift": found[:, 1]})

    return vertices.unionByName(ends).groupBy("task", "part").applyInPandas(solve, f"node long, cluster {kind}, mis int, changed long, shift long")
