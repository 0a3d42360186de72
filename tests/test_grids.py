"""Grids, lookups with their errors, and remaining sites, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import grids, lattice, lookups


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_grids(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    assert one(spark, grids.linspace(*lit(0.0, 1.0, 5))) == [0, 0.25, 0.5, 0.75, 1] and one(spark, grids.linspace(*lit(0.3, 1.0, 1))) == [0.3] and one(spark, grids.linspace(*lit(0.3, 1.0, 0))) == []
    assert one(spark, grids.arithmetic(*lit(0.0, 0.1, 1.0)))[-1] == pytest.approx(1.0) and len(one(spark, grids.arithmetic(*lit(0.0, 0.1, 1.0)))) == 11
    assert one(spark, grids.arithmetic(*lit(1.0, -0.5, 0.0))) == [1, 0.5, 0] and one(spark, grids.arithmetic(*lit(1.0, 0.5, 0.0))) == [] and one(spark, grids.arithmetic(*lit(0.0, 0.0, 1.0))) == []
    got = one(spark, grids.concentrated(*lit(0.3, 0.5, 0.42, 21, 3.0)))
    want = set()
    for i in range(21):
        t = -1 + 2 * i / 20
        v = 0.42 + (1 if t > 0 else -1) * abs(t) ** 3 * 0.12
        if 0.3 - 1e-9 <= v <= 0.5 + 1e-9:
            want.add(round(v, 6))
    assert got == sorted(want)
    got = one(spark, grids.dense(*lit(0.1, 0.9, 12, 0.4, 0.5, 4)))
    assert len(got) == 12 and got == sorted(got) and sum(0.4 < v < 0.5 for v in got) == 4 and {0.1, 0.4, 0.5, 0.9} <= {round(v, 9) for v in got}
    assert one(spark, grids.dense(*lit(0.0, 1.0, 3, -1.0, 0.5, 4))) == [0, 0.5, 1]


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "a", 9.0), (2, "a", None), (None, "a", 5.0), (1, "a", 7.0)], "k long, c string, own double")
    cache = spark.createDataFrame([(1, 3.0), (3, 4.0), (2, None), (None, 8.0)], "k long, tau double")
    assert sorted((r["k"] or 0, r["tau"] or 0) for r in lookups.looked_up(rows, cache, ["k"], "tau", "own").collect()) == [(0, 5.0), (1, 3.0), (1, 3.0), (2, 0)]
    assert lookups.looked_up(rows.where("k = 1"), cache, ["k"], "tau", strict=True).count() == 2
    with pytest.raises(ValueError, match="missing"):
        lookups.looked_up(rows, cache, ["k"], "tau", strict=True)
    with pytest.raises(ValueError, match="more than once"):
        lookups.looked_up(rows, cache.unionByName(cache), ["k"], "tau")


def test_nearest_targets(spark):
    rng = random.Random(1)
    targets = [(k, round(0.01 * i + rng.random() / 1000, 6)) for k in "ab" for i in range(40)]
    raw = [(k, v + rng.uniform(-4e-6, 4e-6)) for k, v in targets]
    frame = lambda rows: spark.createDataFrame(rows, "k string, rho double").withColumn("target_", F.lit(1))
    goal = spark.createDataFrame(targets, "k string, rho double")
    got = lookups.nearest_target(frame(raw + [("a", 0.777), (None, 0.1), ("a", None)]), goal, ["k"], "rho", 5e-6).collect()
    near = {(r["k"], r["rho"]): r["target"] for r in got}
    assert len(got) == 83 and all(near[k, v] == t for (k, v), (_, t) in zip(raw, targets)) and near["a", 0.777] is None and near[None, 0.1] is None
    with pytest.raises(ValueError, match="more than one"):
        lookups.nearest_target(frame(raw + [("a", targets[0][1])]), goal, ["k"], "rho", 5e-6)
    with pytest.raises(ValueError, match="no value"):
        lookups.nearest_target(frame(raw[1:]), goal, ["k"], "rho", 5e-6)


@pytest.mark.parametrize("length,k,share", [(6, 2, 0.3), (9, 1, 0.12), (4, 3, 0.9)])
def test_remaining(spark, length, k, share):
    rng = random.Random(length)
    occ = {(s, i): int(rng.random() < share) for s in range(3) for i in range(length * length)}
    table = spark.createDataFrame([(s, i, i % length, i // length, o) for (s, i), o in occ.items()], "sample_id int, site long, x long, y long, occ int")
    near = lambda i: {i // length * length + (i + d) % length for d in (1, -1)} | {(i // length + d) % length * length + i % length for d in (1, -1)}
    want = set()
    for s in range(3):
        free = {i for i in range(length * length) if sum(occ[s, j] for j in near(i)) < k}
        left, best = {i for i in free if near(i) & free}, []
        while left:
            part, stack = set(), [min(left)]
            while stack:
                i = stack.pop()
                if i in left and i not in part:
                    part.add(i)
                    stack += near(i)
            left -= part
            best = part if len(part) > len(best) else best
        want |= {(s, i) for i in best}
    got = lattice.remaining(table, length, k).collect()
    assert len(got) == len(occ) and {(r["sample_id"], r["site"]) for r in got if r["remain"]} == want
