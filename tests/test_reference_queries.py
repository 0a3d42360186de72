"""Lattice, matching and statistics operators against brute force and against SQL in another engine."""

import itertools
import os
import random

import duckdb
import numpy as np
import pytest

from latticework.jobs import registry
from latticework.operators import lattice, matching
from latticework.operators.components import connected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "customer supplier part orders lineitem events".split():
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(df):
    cell = lambda x: None if x is None or x != x else x if isinstance(x, str) else round(float(x), 6) + 0.0
    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("length", [2, 4, 8])
def test_local_rules_by_hand(spark, length):
    table = lattice.sites(spark.range(length * length).toDF("site"), "site", length, 3, 0.35)
    got = {(r["sample_id"], r["site"]): r for r in lattice.local_rules(table, length).collect()}
    for s in range(3):
        occ = np.array([got[s, i]["occ"] for i in range(length * length)]).reshape(length, length)
        near = lambda a: sum(np.roll(a, d, ax) for ax in (0, 1) for d in (1, -1))
        core = (occ == 1) & (near(occ) > 0)
        active = near(core.astype(int)) == 0
        assert [got[s, i]["core"] for i in range(length**2)] == core.astype(int).ravel().tolist()
        assert [got[s, i]["active"] for i in range(length**2)] == active.astype(int).ravel().tolist()


def test_components_by_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ground_states_by_enumeration(spark):
    rng = random.Random(4)
    rows = [(g, x, y) for g in range(40) for x in range(4) for y in range(3) if rng.random() < 0.7]
    got = {r["g"]: r for r in matching.ground_states(spark.createDataFrame(rows, "g int, x int, y int"), ["g"]).collect()}
    for g in range(40):
        own = [(x, y) for k, x, y in rows if k == g]
        best, inside = 0, []
        for bits in itertools.product((0, 1), repeat=len(own)):
            chosen = {p for p, b in zip(own, bits) if b}
            if any((x + 1, y) in chosen or (x, y + 1) in chosen for x, y in chosen):
                continue
            if len(chosen) > best:
                best, inside = len(chosen), []
            if len(chosen) == best:
                inside.append(chosen)
        every, some = set.intersection(*inside), set.union(*inside)
        r = got[g]
        assert r["mis"] == best and r["n_active"] == len(own)
        for p, side in ((0, "a"), (1, "b")):
            on = [v for v in own if sum(v) % 2 == p]
            assert r[f"in_{side}"] == sum(v in every for v in on)
            assert r[f"out_{side}"] == sum(v not in some for v in on)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
