"""Block models, blocked sites of open lattices and the undetermined graph, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from latticework.operators import blocks, lattice, pairing


def made(spark, length, share, seed=1, samples=2):
    rng = random.Random(seed)
    rows = [(s, i, i % length, i // length, int(rng.random() < share), int(rng.random() < 0.8)) for s in range(samples) for i in range(length * length)]
    return {(r[0], r[2], r[3]): (r[4], r[5]) for r in rows}, spark.createDataFrame(rows, "sample_id int, site long, x long, y long, occ int, free int").repartition(3)


@pytest.mark.parametrize("length,k", [(6, 2), (6, 3), (4, 4)])
def test_block_model(spark, length, k):
    on, table = made(spark, length, 0.4, length + k)
    spins, couplings = blocks.block_model(table, length, k)
    got = {(r["sample_id"], r["bx"], r["by"]): r for r in spins.collect()}
    links = {(r["sample_id"], r["bx"], r["by"], r["side"]): r["coupling"] for r in couplings.collect()}
    parts = length // k
    assert len(got) == 2 * parts**2 and len(links) == 4 * len(got)
    for s, bx, by in got:
        inside = [(x, y) for x in range(bx * k, bx * k + k) for y in range(by * k, by * k + k)]
        m = sum((1 if (x + y) % 2 == 0 else -1) * on[s, x, y][0] * on[s, x, y][1] for x, y in inside)
        r = got[s, bx, by]
        assert r["field"] == sum((1 if (x + y) % 2 == 0 else -1) * on[s, x, y][1] for x, y in inside) and r["tie"] == (m == 0) and r["spin"] in (1, -1) and (m == 0 or r["spin"] * m > 0)
        for side, (dx, dy) in enumerate(((0, -1), (1, 0), (0, 1), (-1, 0))):
            ends = [((x, y), (x + dx, y + dy)) for x, y in inside if not (bx * k <= x + dx < bx * k + k and by * k <= y + dy < by * k + k)]
            empty = lambda p: on[s, p[0] % length, p[1] % length] == (0, 1)  # noqa: E731, B023
            assert links[s, bx, by, side] == sum(empty(a) and empty(b) for a, b in ends)
    with pytest.raises(ValueError):
        blocks.block_model(table, length, 5)


@pytest.mark.parametrize("share", [0.1, 0.4])
def test_blocked_open(spark, share):
    length = 6
    on, table = made(spark, length, share)
    got = {(r["sample_id"], r["x"], r["y"]): r["state"] for r in blocks.blocked_open(table, length).collect()}
    near = lambda s, x, y: [(s, x + a, y + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (s, x + a, y + b) in on]
    blocked = set()
    for p in on:
        corner = p[1] in (0, length - 1) and p[2] in (0, length - 1)
        beside = any(on[q][0] for q in near(*p))
        if (on[p][0] or beside) if corner else (on[p][0] and beside):
            blocked.add(p)
    assert got == {p: 1 if p in blocked else 2 if any(q in blocked for q in near(*p)) else 0 for p in on}


def test_undetermined_graph(spark):
    length = 6
    _, table = made(spark, length, 0.7, 3)
    own = lattice.clusters(table.withColumn("on", F.col("occ")), "on", length)
    vertices, edges = lattice.bipartite_graph(own, length)
    solved = pairing.ground(vertices, edges)
    state = {(r["node"] // 36, r["node"] % 36): r for r in solved.collect()}
    free = {p for p, r in state.items() if r["state"] is None}
    lines = {(r["sample_id"], r["site"]): r["line"] for r in blocks.undetermined_graph(solved, edges, length).collect()}
    assert set(lines) == free and free
    for (s, i), line in lines.items():
        assert re.fullmatch(r"\(\d+,\d+\):( \(\d+,\d+\) [01];)+", line) and line.startswith(f"({i % 6},{i // 6}):")
        ends = {(int(y) * 6 + int(x), f) for x, y, f in re.findall(r" \((\d+),(\d+)\) ([01])", line)}
        x, y = i % 6, i // 6
        near = {y * 6 + (x + 1) % 6, y * 6 + (x - 1) % 6, (y + 1) % 6 * 6 + x, (y - 1) % 6 * 6 + x}
        assert {j for j, _ in ends} == {j for j in near if (s, j) in free} and [j for j, f in ends if f == "1"] == [state[s, i]["partner"] % 36]
