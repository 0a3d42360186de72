"""Closed sets of an acyclic graph: sets of nodes that hold all predecessors of each of theirs. Counted exactly, listed where they are few.

Weak components are independent, so each is counted on its own and a task holds a bounded number of small ones; the closed sets of a matching's core are the ground states of its lattice.
"""

from __future__ import annotations

import random
from math import log10, prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(parents: dict[int, set[int]]) -> list[int]:
    """The nodes, predecessors first; of those that may come next, one after which the fewest nodes are still waited for."""
    children: dict[int, set[int]] = {n: set() for n in parents}
    for n, own in parents.items():
        for p in own:
            children[p].add(n)
    waiting, open_, out = {n: len(own) for n, own in parents.items()}, {n: len(c) for n, c in children.items()}, []
    free = {n for n, k in waiting.items() if not k}
    while free:
        cost = lambda n: (bool(children[n]) - sum(open_[p] == 1 for p in parents[n]), n)
        n = min(free, key=cost)
        free.remove(n)
        out.append(n)
        for p in parents[n]:
            open_[p] -= 1
        for c in children[n]:
            waiting[c] -= 1
            if not waiting[c]:
                free.add(c)
    return out


def listed(parents: dict[int, set[int]], order: list[int]) -> list[int]:
    """All closed sets as bit masks, ascending; bit i is the i-th of ``order``."""
    at = {n: i for i, n in enumerate(order)}
    needs = [sum(1 << at[p] for p in parents[n]) for n in order]
    states = [0]
    for i, need in enumerate(needs):
        states += [s | 1 << i for s in states if s & need == need]
    return sorted(states)


def counted(parents: dict[int, set[int]], most_states: int = 200_000) -> tuple[int, int]:
    """The exact number of closed sets, and the greatest number of states that were held at once.

    Nodes are taken in ``ordered``; a state tells which of the nodes that are still waited for are in the set, and holds the number of ways to it. Beyond ``most_states``
    the sets with and without one node are counted apart: with it go its ancestors, without it its descendants, and what is left falls into smaller parts.
    """
    order, left = ordered(parents), {n: 0 for n in parents}
    for own in parents.values():
        for p in own:
            left[p] += 1
    states, widest = {frozenset(): 1}, 1
    for n in order:
        gone = set()
        for p in parents[n]:
            left[p] -= 1
            if not left[p]:
                gone.add(p)
        after: dict[frozenset, int] = {}
        for held, ways in states.items():
            key = held - gone
            after[key] = after.get(key, 0) + ways
            if parents[n] <= held:
                key = key | {n} if left[n] else key
                after[key] = after.get(key, 0) + ways
        states, widest = after, max(widest, len(after))
        if len(states) > most_states:
            return _split(parents, most_states, widest)
    return sum(states.values()), widest


def _pivot(parents: dict[int, set[int]]) -> tuple[set[int], set[int]]:
    """Ancestors and descendants, both with the node itself, of the node of which both are many."""
    above: dict[int, set[int]] = {}
    for n in ordered(parents):
        above[n] = set().union({n}, *(above[p] for p in parents[n]))
    below: dict[int, set[int]] = {n: set() for n in parents}
    for m, own in above.items():
        for n in own:
            below[n].add(m)
    n = max(parents, key=lambda n: (min(len(above[n]), len(below[n])), len(above[n]) + len(below[n]), -n))
    return above[n], below[n]


def _without(parents: dict[int, set[int]], gone: set[int]) -> list[dict[int, set[int]]]:
    return _parts({m: own - gone for m, own in parents.items() if m not in gone})


def _split(parents: dict[int, set[int]], most_states: int, widest: int) -> tuple[int, int]:
    total = 0
    for gone in _pivot(parents):
        ways = 1
        for part in _without(parents, gone):
            k, w = counted(part, most_states)
            ways, widest = ways * k, max(widest, w)
        total += ways
    return total, widest


def drawn(parents: dict[int, set[int]], draws: int, rng: random.Random, most_states: int = 200_000) -> list[set[int]]:
    """``draws`` closed sets, each one of all with equal probability: states backwards from the last node, by their exact numbers of ways.

    Beyond ``most_states`` a draw first chooses between the sets with and without one node, by their exact numbers, then draws in what is left.
    """
    order, left = ordered(parents), {n: 0 for n in parents}
    for own in parents.values():
        for p in own:
            left[p] += 1
    layers, states = [], {frozenset(): 1}
    for n in order:
        gone = set()
        for p in parents[n]:
            left[p] -= 1
            if not left[p]:
                gone.add(p)
        came: dict[frozenset, list[tuple[frozenset, bool, int]]] = {}
        for held, ways in states.items():
            key = held - gone
            came.setdefault(key, []).append((held, False, ways))
            if parents[n] <= held:
                came.setdefault(key | {n} if left[n] else key, []).append((held, True, ways))
        states = {key: sum(w for _, _, w in own) for key, own in came.items()}
        if len(states) > most_states:
            return _drawn_apart(parents, draws, rng, most_states)
        layers.append((n, came))
    out = []
    for _ in range(draws):
        at, chosen = frozenset(), set()
        for n, came in reversed(layers):
            pick = rng.randrange(sum(w for _, _, w in came[at]))
            for held, inside, ways in came[at]:
                pick -= ways
                if pick < 0:
                    break
            at = held
            if inside:
                chosen.add(n)
        out.append(chosen)
    return out


def _drawn_apart(parents: dict[int, set[int]], draws: int, rng: random.Random, most_states: int) -> list[set[int]]:
    above, below = _pivot(parents)
    inside, outside = _without(parents, above), _without(parents, below)
    with_it, without_it = (prod(counted(part, most_states)[0] for part in parts) for parts in (inside, outside))
    taken = [rng.randrange(with_it + without_it) < with_it for _ in range(draws)]
    out: list[set[int]] = [set(above) if t else set() for t in taken]
    for side, parts in ((True, inside), (False, outside)):
        which = [i for i, t in enumerate(taken) if t == side]
        for part in parts if which else ():
            for i, own in zip(which, drawn(part, len(which), rng, most_states)):
                out[i] |= own
    return out


def _parts(parents: dict[int, set[int]]) -> list[dict[int, set[int]]]:
    near: dict[int, set[int]] = {n: set(own) for n, own in parents.items()}
    for n, own in parents.items():
        for p in own:
            near[p].add(n)
    out, seen = [], set()
    for n in parents:
        if n in seen:
            continue
        seen.add(n)
        part, stack = {}, [n]
        while stack:
            m = stack.pop()
            part[m] = parents[m]
            for k in near[m] - seen:
                seen.add(k)
                stack.append(k)
        out.append(part)
    return out


def _tasks(nodes: DataFrame, dag: DataFrame, a_task: int = 10_000) -> DataFrame:
    before = dag.groupBy(F.col("dst").alias("node")).agg(F.collect_set("src").alias("before"))
    n = nodes.count()
    return nodes.select("node", "weak").join(before, "node", "left").withColumn("task", F.pmod(F.xxhash64("weak"), F.lit(max(1, n // a_task))))


def _each(own: pd.DataFrame):
    for weak, rows in own.groupby("weak", sort=True):
        yield weak, {int(n): {int(p) for p in b} if b is not None else set() for n, b in zip(rows["node"], rows["before"])}


def counts(nodes: DataFrame, dag: DataFrame, most_states: int = 200_000) -> DataFrame:
    """``(weak, nodes, states, log10_states, widest)``: the exact number of closed sets of each weak component of ``nodes(node, weak)`` under ``dag(src, dst)``, as a decimal string.

    One row a weak component; a task holds whole ones, about 10,000 nodes. An edge whose ends are in different weak components isn't allowed; empty tables give an empty result.
    """

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        found = [(weak, len(parents), *counted(parents, most_states)) for weak, parents in _each(own)]
        return pd.DataFrame([(w, k, str(c), _log10(c), widest) for w, k, c, widest in found], columns=["weak", "nodes", "states", "log10_states", "widest"])

    return _tasks(nodes, dag).groupBy("task").applyInPandas(solve, "weak long, nodes long, states string, log10_states double, widest long")


def _log10(n: int) -> float:
    shift = max(0, n.bit_length() - 900)
    return log10(n >> shift) + shift * log10(2)


def states(nodes: DataFrame, dag: DataFrame, most_nodes: int = 20) -> DataFrame:
    """``(weak, state, size)``: every closed set of each weak component of at most ``most_nodes`` (62 or fewer) nodes.

    ``state`` has bit i for the component's i-th node in ``ordered``. Larger components have no rows here: ``counts`` counts them.
    """
    if most_nodes > 62:
        raise ValueError("a state must fit a long")

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        found = [(weak, s, s.bit_count()) for weak, parents in _each(own) if len(parents) <= most_nodes for s in listed(parents, ordered(parents))]
        return pd.DataFrame(found, columns=["weak", "state", "size"])

    return _tasks(nodes, dag).groupBy("task").applyInPandas(solve, "weak long, state long, size int")


def samples(nodes: DataFrame, dag: DataFrame, draws: int, seed: int = 0, most_states: int = 200_000) -> DataFrame:
    """``(weak, draw, node)``: the nodes of ``draws`` closed sets of each weak component, each set with equal probability; an empty set has no row.

    The numbers come from a generator of ``seed`` and the component, so a task that is run again draws the same. Draws of different components are independent: equal ``draw`` makes one
    state of the whole.
    """

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        found = [(weak, i, n) for weak, parents in _each(own) for i, chosen in enumerate(drawn(parents, draws, random.Random(f"{seed}-{weak}"), most_states)) for n in sorted(chosen)]
        return pd.DataFrame(found, columns=["weak", "draw", "node"])

    return _tasks(nodes, dag).groupBy("task").applyInPandas(solve, "weak long, draw int, node long")
