"""Ground states of periodic lattices by enumeration, half sweeps against arrays, queries against each other."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from latticework.jobs import registry
from latticework.operators import dynamics, lattice, matching

SF = "/root/testdata/sf0.001"


def test_periodic_ground_sites_by_enumeration(spark):
    rng = random.Random(11)
    rows = [(g, x, y) for g in range(30) for x in range(4) for y in range(4) if rng.random() < 0.6] + [(30, 0, 0), (31, 0, 0), (31, 3, 0)]
    found = {}
    for r in matching.ground_sites(spark.createDataFrame(rows, "g int, x int, y int"), ["g"], 4).collect():
        found.setdefault(r["g"], {})[r["x"], r["y"]] = r
    for g in range(32):
        own = [(x, y) for k, x, y in rows if k == g]
        pairs = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if sorted(min((p - q) % 4, (q - p) % 4) for p, q in zip(own[a], own[b])) == [0, 1]]
        masks = [(1 << a) | (1 << b) for a, b in pairs]
        free = [m for m in range(1 << len(own)) if all(m & e != e for e in masks)]
        size = max(m.bit_count() for m in free)
        best = [m for m in free if m.bit_count() == size]
        even = sum(1 << i for i, p in enumerate(own) if sum(p) % 2 == 0)
        least = min((m & even).bit_count() for m in best)
        assert len([m for m in best if (m & even).bit_count() == least]) == 1
        (want,) = [m for m in best if (m & even).bit_count() == least]
        for i, p in enumerate(own):
            ins = {m >> i & 1 for m in best}
            assert found[g][p]["state"] == (ins.pop() if len(ins) == 1 else None)
            assert found[g][p]["mis"] == want >> i & 1 and found[g][p]["side"] == sum(p) % 2


def test_ground_sites_of_nothing(spark):
    assert matching.ground_sites(spark.createDataFrame([], "g int, x int, y int"), ["g"], 4).count() == 0


def test_grid_neighbours(spark):
    for n, dims in ((2, 2), (4, 2), (2, 3), (4, 3), (3, 3)):
        got = {r["site"]: sorted(r["nb"]) for r in spark.range(n**dims).select(F.col("id").alias("site")).select("site", lattice.grid_neighbours(n, dims).alias("nb")).collect()}
        for site in range(n**dims):
            at = np.unravel_index(site, (n,) * dims)
            near = {int(np.ravel_multi_index([(c + d) % n if i == a else c for i, c in enumerate(at)], (n,) * dims)) for a in range(dims) for d in (1, -1)}
            assert got[site] == sorted(near)


def test_half_sweep_by_hand(spark):
    n, rng = 6, np.random.default_rng(3)
    s = rng.integers(0, 3, (2, n, n))
    rows = [(i, y * n + x, int(s[i, y, x])) for i in range(2) for y in range(n) for x in range(n)]
    table = spark.createDataFrame(rows, "sample_id int, site long, s int")
    got = {(r["sample_id"], r["site"]): r["s"] for r in dynamics.half_sweep(table, n, 1, 3, F.lit(1.0), (F.col("w0") + 10 * F.col("w1") + 100 * F.col("w2") + 1000 * F.col("s"))).collect()}
    near = lambda a: sum(np.roll(a, d, ax) for ax in (1, 2) for d in (1, -1))
    want = near(s == 0) * 1 + 10 * near(s == 1) + 100 * near(s == 2) + 1000 * s
    for i in range(2):
        for y in range(n):
            for x in range(n):
                assert got[i, y * n + x] == (want if (x + y) % 2 else s)[i, y, x]
    assert dynamics.swept(table.limit(0), n, 1, 3, F.lit(1.0), lambda t: F.col("s")).count() == 0


def test_gaussian_and_bonds(spark):
    z = [r[0] for r in spark.range(20000).select(dynamics.gaussian(F.lit(1), F.col("id"))).collect()]
    assert abs(np.mean(z)) < 0.03 and abs(np.std(z) - 1) < 0.03 and all((v * 2**20).is_integer() for v in z)
    a, b = spark.range(1).select(dynamics.bond_key(F.lit(3), F.lit(11)).alias("a"), dynamics.bond_key(F.lit(11), F.lit(3)).alias("b")).first()
    assert a == b


def test_ground_queries_agree(spark):
    """Counts of the two queries and of the active sites fit, and no two members are neighbours."""
    active = {r["sample_id"]: r["n_active"] for r in registry.QUERIES["lattice_rules"](spark, SF).collect()}
    rows = registry.QUERIES["ground_observables"](spark, SF).collect()
    whole, bonds = {r["sample_id"]: r for r in rows if not r["largest"]}, {r["sample_id"]: r for r in registry.QUERIES["ground_bonds"](spark, SF).collect()}
    assert {s: r["n_a"] + r["n_b"] for s, r in whole.items()} == active == {s: r["n_active"] for s, r in bonds.items()}
    for s, r in whole.items():
        assert r["in_a"] + r["out_a"] + r["free_a"] == r["n_a"] and r["mis_a"] == r["in_a"] and r["mis_b"] == r["n_b"] - r["out_b"]
        # with no two members side by side, a bond has one member or none
        n, d = bonds[s]["n_bonds"], round(bonds[s]["defects"] * active[s])
        assert round(bonds[s]["spins"] * active[s]) == d - (n - d)
