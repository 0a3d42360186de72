"""Bipartite ground states of site groups, one group a task row: matching, independent sets, frozen sites."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def greatest_matching(left: list[int], edges: dict[int, list[int]]) -> dict[int, int]:
    """Partner of each matched vertex, on both sides, in a matching of greatest size (shortest augmenting paths by layers)."""
    to: dict[int, int] = {}
    while True:
        layer = {u: 0 for u in left if u not in to}
        queue, open_ = deque(layer), False
        while queue:
            u = queue.popleft()
            for v in edges.get(u, ()):
                if v not in to:
                    open_ = True
                elif to[v] not in layer:
                    layer[to[v]] = layer[u] + 1
                    queue.append(to[v])
        if not open_:
            return to
        rest = {u: iter(edges.get(u, ())) for u in layer}
        for root in [u for u in left if u not in to]:
            path = [root]
            while path:
                u = path[-1]
                v = next(rest[u], None)
                if v is None:
                    layer.pop(u, None)
                    path.pop()
                elif v not in to:
                    for w in reversed(path):  # hand each vertex's partner on
                        to[w], v = v, to.get(w)
                        to[to[w]] = w
                    break
                elif layer.get(to[v]) == layer[u] + 1:
                    path.append(to[v])


def frozen(vertices: list[int], edges: dict[int, list[int]], to: dict[int, int]) -> dict[int, int]:
    """1 for vertices in every greatest independent set, 0 for those in none; others are left out.

    An unmatched vertex is in all; a neighbour of one that is in all is in none; its partner is in all again.
    """
    state = {v: 1 for v in vertices if v not in to}
    queue = deque(state)
    while queue:
        v = queue.popleft()
        for w in edges.get(v, ()):
            if w not in state:
                state[w] = 0
                if state.setdefault(to[w], 1) == 1:
                    queue.append(to[w])
    return state


def once(keys: np.ndarray) -> np.ndarray:
    """The different ``keys``, ascending; sorting is much faster here than the hashing of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=keys[:1] - 1) != 0]


def neighbours(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours ``heads[starts[i]:starts[i + 1]]`` of each of the nodes 0 to n - 1 by the edges ``a[i]``, ``b[i]``, ascending and each once."""
    keys = once(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(keys, np.arange(n + 1) * n), keys % n if n else keys


def _ends(of: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of each edge at the nodes ``of``."""
    sizes = starts[of + 1] - starts[of]
    before = np.cumsum(sizes) - sizes
    return np.repeat(of, sizes), heads[np.repeat(starts[of] - before, sizes) + np.arange(sizes.sum())]


def _leaves_matched(to: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> None:
    """Match each node with one neighbour left to it, again and again: some greatest matching holds these pairs."""
    left, degree = to < 0, np.diff(starts)
    leaves = np.flatnonzero(degree == 1)
    by = np.full(len(to), -1)
    while len(leaves):
        a, b = _ends(leaves, starts, heads)
        a, b = a[left[b]], b[left[b]]
        by[b] = a  # of the leaves at one node the last
        a, b = a[by[b] == a], b[by[b] == a]
        first = (by[a] != b) | (a < b)  # two leaves that are each other's
        a, b = a[first], b[first]
        to[a], to[b] = b, a
        by[b] = -1
        left[a] = left[b] = False
        by[a] = -1
        near = _ends(np.concatenate([a, b]), starts, heads)[1]
        np.subtract.at(degree, near, 1)
        near = once(near)
        leaves = near[left[near] & (degree[near] == 1)]


def matched(side: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Partner of each node, -1 for none, in a matching of greatest size of a bipartite graph in ``neighbours``' form.

    Leaves first. Then alternating trees grow from all open nodes of side 0 at once; each that meets an open node gives one augmenting path. A phase without any has shown that there is none.
    """
    to = np.full(len(side), -1)
    _leaves_matched(to, starts, heads)
    while True:
        front = np.flatnonzero((to < 0) & (side == 0) & (np.diff(starts) > 0))
        tree, by, end = np.full(len(side), -1), np.full(len(side), -1), np.full(len(side), -1)
        tree[front] = front
        while len(front):
            u, v = _ends(front, starts, heads)
            u, v = u[by[v] < 0], v[by[v] < 0]
            by[v] = u
            u, v = u[by[v] == u], v[by[v] == u]
            open_ = to[v] < 0
            end[tree[u[open_]]] = v[open_]
            grown = (end[tree[u]] < 0) & ~open_
            front = to[v[grown]]
            tree[front] = tree[u[grown]]
        v = end[end >= 0]
        if not len(v):
            return to
        while len(v):
            u = by[v]
            before = to[u]
            to[u], to[v] = v, u
            v = before[before >= 0]


def held(to: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """``frozen`` for a matching ``to`` of greatest size: 1, 0, and -1 for undetermined nodes."""
    state = np.where(to < 0, 1, -1)
    front = np.flatnonzero(to < 0)
    while len(front):
        near = _ends(front, starts, heads)[1]
        near = once(near[state[near] < 0])
        state[near] = 0
        front = to[near]
        front = front[state[front] < 0]
        state[front] = 1
    return state


def _solved(own: pd.DataFrame, length: int | None) -> tuple[list[int], int, dict[int, int]]:
    """Side of the checkerboard of each row's site, the matching's size, and the frozen states; ``length`` is the period of both sides, None for open ones."""
    xy = list(zip(own["x"].tolist(), own["y"].tolist()))
    at = {p: i for i, p in enumerate(xy)}
    wrap = (lambda x, y: (x % length, y % length)) if length else (lambda x, y: (x, y))
    edges = {i: sorted({at[n] for n in (wrap(x + 1, y), wrap(x - 1, y), wrap(x, y + 1), wrap(x, y - 1)) if n in at}) for (x, y), i in at.items()}
    side = [(x + y) % 2 for x, y in xy]
    to = greatest_matching([i for i, s in enumerate(side) if s == 0], edges)
    return side, len(to) // 2, frozen(list(range(len(side))), edges, to)


def ground_states(sites: DataFrame, group: list[str]) -> DataFrame:
    """One row for each group of ``sites(…, x, y)``, taken as an open lattice piece of active sites.

    n_active, matching, mis (active less matching), then frozen counts by side of the checkerboard: in all
    greatest independent sets (``in_a``, ``in_b``), in none (``out_a``, ``out_b``) and undetermined (``free_a``, ``free_b``).
    """
    names = ["n_active", "matching", "mis", "in_a", "in_b", "out_a", "out_b", "free_a", "free_b"]

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        side, m, state = _solved(own, None)
        count = lambda s, p: sum(1 for i, q in enumerate(side) if q == p and state.get(i) == s)
        return pd.DataFrame([[*key, len(side), m, len(side) - m, count(1, 0), count(1, 1), count(0, 0), count(0, 1), count(None, 0), count(None, 1)]], columns=[*group, *names])

    return sites.select(*group, "x", "y").groupBy(*group).applyInPandas(solve, _kinds(sites, group) + ", " + ", ".join(f"{n} long" for n in names))


def _kinds(sites: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in sites.schema.fields}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def ground_sites(sites: DataFrame, group: list[str], length: int) -> DataFrame:
    """``(*group, x, y, side, state, mis)`` of the active ``sites(*group, x, y)`` of lattices with even period ``length``.

    A group is a connected set of active sites (their cluster), so a task holds one cluster and never more than one lattice. state: 1 in every greatest
    independent set, 0 in none, null in some. mis is the greatest independent set that the sites of side 0 enter only where they
    must: those with state 1, and those of side 1 without state 0. It doesn't depend on the matching that was found.
    """

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        side, _, state = _solved(own, length)
        found = [state.get(i) for i in range(len(side))]
        mis = [int(s == 1 if p == 0 else s != 0) for s, p in zip(found, side)]
        return own.assign(side=side, state=pd.array(found, "Int32"), mis=mis)

    return sites.select(*group, "x", "y").groupBy(*group).applyInPandas(solve, _kinds(sites, [*group, "x", "y"]) + ", side int, state int, mis int")
