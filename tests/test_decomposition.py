"""Directed graphs, matchings by joins, closed sets and responses, against plain versions."""

import random
from itertools import combinations
from math import prod

import pytest
from pyspark.sql import functions as F

from latticework.functions.ranks import numbered
from latticework.operators import closed_sets, digraph, lattice, pairing, responses
from latticework.operators.matching import frozen, greatest_matching
from latticework.operators.responses import Reached, response


def graph(seed, n, m):
    rng = random.Random(seed)
    return {(a, b) for a, b in ((rng.randrange(n) * 3, rng.randrange(n) * 3) for _ in range(m)) if a != b}


def closure(edges):
    nodes = sorted({a for e in edges for a in e})
    go = {a: {b for c, b in edges if c == a} for a in nodes}
    reach = {}
    for a in nodes:
        seen, stack = {a}, [a]
        while stack:
            for b in go[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        reach[a] = seen
    return reach


def frame(spark, edges):
    rows = [*edges, *list(edges)[:3], (3, 3), (None, 6), (6, None)]
    return spark.createDataFrame(rows, "src long, dst long").withColumn("node", F.lit("clash")).repartition(3)


@pytest.mark.parametrize("seed,n,m,limit", [(1, 40, 55, 10), (3, 60, 60, 1000), (4, 25, 90, 0)])
def test_strong_components_and_levels(spark, seed, n, m, limit):
    """``limit`` 0 sends all parts through the rounds of joins, 1000 none."""
    edges = graph(seed, n, m)
    reach = closure(edges)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach} | {1001: 1001}
    alone = spark.createDataFrame([(1001,), (None,)], "node long")
    found = digraph.strong_components(frame(spark, edges), alone, limit=limit)
    assert {r["node"]: r["component"] for r in found.collect()} == want
    dag = digraph.condensation(frame(spark, edges), found)
    between = {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    assert sorted((r["src"], r["dst"]) for r in dag.collect()) == sorted(between)

    def level(x):
        return max((level(a) + 1 for a, b in between if b == x), default=0)

    got = digraph.levels(dag, found.select(F.col("component").alias("node")), limit=limit).collect()
    assert {r["node"]: r["level"] for r in got} == {x: level(x) for x in set(want.values())} and len(got) == len(set(want.values()))
    parts = digraph.weak_components(frame(spark, edges))
    for limits in ({}, {"parts": parts.withColumnRenamed("component", "part"), "limit": limit}):
        weak = {r["node"]: r["component"] for r in digraph.weak_components(frame(spark, edges), **limits).collect()}
        both = closure(edges | {(b, a) for a, b in edges})
        assert weak == {a: min(both[a]) for a in both}


def test_long_chains_by_rounds(spark):
    """A way of many nodes in the worst order of names, and a ring."""
    chain = [(i, i + 1) for i in range(30)] + [(1000 + i, 1000 + (i + 1) % 30) for i in range(30)]
    found = {r["node"]: r["component"] for r in digraph.strong_components(spark.createDataFrame(chain, "src long, dst long"), limit=0).collect()}
    assert found == {i: i for i in range(31)} | {1000 + i: 1000 for i in range(30)}


def test_cycles_have_no_levels(spark):
    ring = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    for limit in (0, 10):
        with pytest.raises(ValueError):
            digraph.levels(ring, limit=limit).count()


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert digraph.strong_components(none).count() == 0 and digraph.levels(none).count() == 0 and digraph.weak_components(none).count() == 0
    assert digraph.condensation(none, digraph.strong_components(none)).count() == 0


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(10**6), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, x long, i long").repartition(6), ["k"], ["x", "i"])
    assert got.columns == ["k", "x", "i", "place"]
    for k in ("a", "b", None):
        own = sorted((r["x"], r["i"], r["place"]) for r in got.collect() if r["k"] == k)
        assert [p for _, _, p in own] == list(range(len(own)))
    assert sorted(r["place"] for r in numbered(spark.createDataFrame(rows, "k string, x long, i long"), [], ["x", "i"]).collect()) == list(range(500))


# ---- closed sets


def test_closed_sets_are_counted_and_listed():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        names = rng.sample(range(100), n)
        parents = {names[i]: {names[j] for j in range(i) if rng.random() < 0.3} for i in range(n)}
        order = closed_sets.ordered(parents)
        at = {x: i for i, x in enumerate(order)}
        want = [s for s in range(1 << n) if all(not s >> at[x] & 1 or all(s >> at[p] & 1 for p in parents[x]) for x in parents)]
        assert closed_sets.listed(parents, order) == want
        assert {closed_sets.counted(parents, most)[0] for most in (1, 3, 10**6)} == {len(want)}


def test_closed_sets_are_drawn_alike():
    """Each closed set comes as often as any other, whether or not the draw is split: a chi-square far from its tail."""
    rng = random.Random(5)
    for most in (10**6, 3, 1):
        parents = {1: set(), 2: {1}, 3: {1}, 4: {2, 3}, 5: set(), 6: {5, 3}, 7: {6}}
        order = closed_sets.ordered(parents)
        want = closed_sets.listed(parents, order)
        at = {x: 1 << i for i, x in enumerate(order)}
        seen = dict.fromkeys(want, 0)
        for chosen in closed_sets.drawn(parents, 200 * len(want), rng, most):
            seen[sum(at[x] for x in chosen)] += 1
        assert sum((k - 200) ** 2 / 200 for k in seen.values()) < len(want) + 5 * (2 * len(want)) ** 0.5


def test_drawn_sets_are_ground_states(spark):
    """A closed set of the core, with its pairs' vertices of side 1 in and those of the other pairs' side 0, is independent."""
    length = 8
    sites, table = site_table(spark, 7, length, 0.75)
    near = plain_near(sites, length)
    vertices, edges = lattice.bipartite_graph(lattice.clusters(table, "on", length), length)
    solved = pairing.ground(vertices, edges)
    core, links = pairing.dependencies(solved, edges)
    found = digraph.strong_components(links, core)
    dag = digraph.condensation(links, found)
    weak = digraph.weak_components(dag, found.select(F.col("component").alias("node"))).withColumnRenamed("component", "weak")
    sets = closed_sets.samples(weak, dag, 5).collect()
    assert sorted(map(tuple, sets)) == sorted(map(tuple, closed_sets.samples(weak, dag, 5).collect()))
    component, rows = {r["node"]: r["component"] for r in found.collect()}, solved.collect()
    for draw in range(5):
        closed = {r["node"] for r in sets if r["draw"] == draw}
        inside = {r["node"] for r in rows if r["state"] == 1}
        for r in core.collect():
            inside.add(r["partner"] if component[r["node"]] in closed else r["node"])
        assert len(inside) == sum(r["mis"] for r in rows)
        at = lambda a: a[0] * length * length + a[1]
        assert not any(at(a) in inside and at(b) in inside for a in near for b in near[a])


def test_closed_set_tables(spark):
    nodes = spark.createDataFrame([(i, i // 10 * 10) for i in [*range(4), *range(10, 13), 20]], "node long, weak long")
    dag = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (10, 11), (10, 12)], "src long, dst long")
    got = {r["weak"]: (r["nodes"], r["states"]) for r in closed_sets.counts(nodes, dag).collect()}
    assert got == {0: (4, "5"), 10: (3, "5"), 20: (1, "2")}
    listed = closed_sets.states(nodes, dag, 3).groupBy("weak").count().collect()
    assert {r["weak"]: r["count"] for r in listed} == {10: 5, 20: 2}
    big = spark.createDataFrame([(i, 0) for i in range(400)], "node long, weak long")
    assert closed_sets.counts(big, spark.createDataFrame([(0, i) for i in range(1, 400)], "src long, dst long")).first()["states"] == str(2**399 + 1)


# ---- matchings and ground states


def site_table(spark, seed, length, share=0.7, samples=2):
    rng = random.Random(seed)
    sites = [(k, s) for k in range(samples) for s in range(length * length) if rng.random() < share]
    rows = spark.createDataFrame(sites, "sample_id int, site long").withColumn("x", F.col("site") % length).withColumn("y", F.expr(f"site div {length}"))
    return sites, rows.withColumn("on", F.lit(1))


def plain_near(sites, length):
    on = set(sites)
    near = {}
    for k, s in sites:
        x, y = s % length, s // length
        near[(k, s)] = sorted({(k, b) for b in (y * length + (x + 1) % length, y * length + (x - 1) % length, (y + 1) % length * length + x, (y - 1) % length * length + x) if (k, b) in on and b != s})
    return near


@pytest.mark.parametrize("length,tile", [(2, 1), (8, 3), (8, 256)])
def test_clusters_by_squares(spark, length, tile):
    sites, table = site_table(spark, length * tile, length, 0.6)
    near = plain_near(sites, length)
    got = {(r["sample_id"], r["site"]): r["cluster"] for r in lattice.clusters(table, "on", length, tile).collect()}
    both = closure({(a, b) for a in near for b in near[a]})
    assert got == {a: min(both.get(a, {a}))[1] for a in near}


@pytest.mark.parametrize("length,limit", [(8, 9), (8, 10_000)])
def test_ground_states_by_joins(spark, length, limit):
    """Small ``limit``: clusters are cut into pieces of so many sites, the matching is closed by joins and states spread by joins."""
    sites, table = site_table(spark, limit, length)
    near = plain_near(sites, length)
    own = lattice.clusters(table, "on", length)
    vertices, edges = lattice.bipartite_graph(own, length, limit)
    if limit < 10:
        assert vertices.groupBy("cluster").agg(F.count_distinct("piece").alias("n")).agg(F.max("n")).first()[0] > 1
    got = {r["node"]: r for r in pairing.ground(vertices, edges).collect()}
    node = lambda a: a[0] * length * length + a[1]
    go = {node(a): [node(b) for b in near[a]] for a in near}
    side = {node(a): (a[1] % length + a[1] // length) % 2 for a in near}
    to = greatest_matching([n for n in go if side[n] == 0 and go[n]], go)
    state = frozen(list(go), go, to)
    assert set(got) == set(go) and {n: got[n]["state"] for n in go} == {n: state.get(n) for n in go}
    partner = {n: r["partner"] for n, r in got.items() if r["partner"] is not None}
    assert len(partner) == len(to) and all(partner[b] == a and b in go[a] for a, b in partner.items())
    assert {n: r["mis"] for n, r in got.items()} == {n: int(state.get(n) == 1 if side[n] == 0 else state.get(n) != 0) for n in go}


def plain_ground_states(near):
    """All greatest independent sets, by going through the subsets."""
    nodes = sorted(near)
    for k in range(len(nodes), -1, -1):
        found = [set(c) for c in combinations(nodes, k) if not any(b in c for a in c for b in near[a])]
        if found:
            return found


def test_core_counts_all_ground_states(spark):
    """The closed sets of the core's components are as many as the greatest independent sets, found by going through all subsets."""
    for seed in range(2):
        sites, table = site_table(spark, seed, 4, 0.75, samples=1)
        near = plain_near(sites, 4)
        vertices, edges = lattice.bipartite_graph(lattice.clusters(table, "on", 4), 4, 4)
        solved = pairing.ground(vertices, edges)
        core, links = pairing.dependencies(solved, edges)
        found = digraph.strong_components(links, core)
        dag = digraph.condensation(links, found)
        weak = digraph.weak_components(dag, found.select(F.col("component").alias("node"))).withColumnRenamed("component", "weak")
        states = prod(int(r["states"]) for r in closed_sets.counts(weak, dag).collect())
        all_ = plain_ground_states(near)
        assert states == len(all_)
        got = {(0, r["node"]): r["state"] for r in solved.collect()}
        assert got == {a: 1 if all(a in s for s in all_) else 0 if not any(a in s for s in all_) else None for a in near}


def plain_mis(near, side):
    to = greatest_matching([n for n in near if side[n] == 0 and near[n]], near)
    state = frozen(list(near), near, to)
    return {n for n in near if (state.get(n) == 1 if side[n] == 0 else state.get(n) != 0)}, to


def test_responses_equal_full_solutions():
    rng = random.Random(2)
    for _ in range(200):
        width = rng.randint(2, 5)
        sites = [(x, y) for x in range(width) for y in range(width + 2) if rng.random() < 0.7]
        at = {p: i for i, p in enumerate(sites)}
        near = {at[(x, y)]: [at[q] for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if q in at] for x, y in sites}
        side = {at[p]: sum(p) % 2 for p in sites}
        mis, to = plain_mis(near, side)
        reached, before = Reached([n for n in near if side[n] == 0 and n not in to], near, to), dict(to)
        for x in near:
            gone = {x} if x in mis else {x, *near[x]}
            other, _ = plain_mis({n: [m for m in near[n] if m not in gone] for n in near if n not in gone}, side)
            other |= set() if x in mis else {x}
            assert response(x, near, side, to, reached) == (len(mis ^ other), len(mis) - len(other)) and to == before


@pytest.mark.parametrize("a_task", [7, 1000])
def test_response_table(spark, a_task):
    """A small ``a_task`` deals a cluster to several tasks."""
    length = 8
    sites, table = site_table(spark, 5, length)
    near = plain_near(sites, length)
    vertices, edges = lattice.bipartite_graph(lattice.clusters(table, "on", length), length)
    got = responses.site_responses(pairing.ground(vertices, edges), edges, a_task).collect()
    go = {k * 64 + s: [j * 64 + t for j, t in near[(k, s)]] for k, s in near}
    side = {n: (n % 64 % 8 + n % 64 // 8) % 2 for n in go}
    mis, _ = plain_mis(go, side)
    assert len(got) == len(sites)
    for r in got:
        x = r["node"]
        gone = {x} if x in mis else {x, *go[x]}
        other, _ = plain_mis({n: [m for m in go[n] if m not in gone] for n in go if n not in gone}, side)
        other |= set() if x in mis else {x}
        assert (r["mis"], r["changed"], r["shift"]) == (int(x in mis), len(mis ^ other), len(mis) - len(other))


def test_no_sites(spark):
    _, table = site_table(spark, 1, 4)
    none = table.where("site < 0")
    vertices, edges = lattice.bipartite_graph(lattice.clusters(none, "on", 4), 4)
    solved = pairing.ground(vertices, edges)
    assert solved.count() == 0 and responses.site_responses(solved, edges).count() == 0
    core, links = pairing.dependencies(solved, edges)
    assert core.count() == 0 and links.count() == 0
