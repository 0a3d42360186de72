"""Clusters and parts beyond the old bounds of a task: worked off in one task, without rounds of joins."""

import random

import numpy as np
from pyspark.sql import functions as F

from latticework.operators import digraph, lattice, pairing, responses
from latticework.operators.matching import frozen, greatest_matching, held, matched, neighbours
from latticework.operators.responses import Near, Reached, placed, response


def none(*_):
    raise AssertionError("went by rounds")


def test_matching_in_arrays_equals_the_plain_one():
    rng = random.Random(3)
    for _ in range(200):
        n, m = rng.randint(1, 14), rng.randint(1, 14)
        edges = sorted({(rng.randrange(n), n + rng.randrange(m)) for _ in range(rng.randint(0, 40))})
        go = {i: [] for i in range(n + m)}
        for a, b in edges:
            go[a].append(b)
            go[b].append(a)
        starts, heads = neighbours(n + m, np.array([a for a, _ in edges], dtype=int), np.array([b for _, b in edges], dtype=int))
        assert [heads[starts[i] : starts[i + 1]].tolist() for i in range(n + m)] == [sorted(go[i]) for i in range(n + m)]
        to = matched(np.array([0] * n + [1] * m), starts, heads)
        plain = greatest_matching([i for i in range(n) if go[i]], go)
        assert (to >= 0).sum() == len(plain) and all(to[to[a]] == a and to[a] in go[a] for a in np.flatnonzero(to >= 0))
        state = frozen(list(go), go, plain)
        assert held(to, starts, heads).tolist() == [state.get(i, -1) for i in go]


def test_large_clusters_go_without_rounds(spark, monkeypatch):
    """A full lattice of 90,000 sites is one cluster; its pairs are one strong component."""
    monkeypatch.setattr(pairing, "augmented", none)
    monkeypatch.setattr(digraph, "_by_rounds", none)
    own = spark.range(300 * 300).select(F.lit(0).alias("sample_id"), F.col("id").alias("site"), F.lit(0).cast("long").alias("cluster"))
    vertices, edges = lattice.bipartite_graph(own, 300)
    solved = pairing.ground(vertices, edges).localCheckpoint()
    got = solved.groupBy("side", "state", "mis").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partner").alias("partners"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, None, 0, 45000, 45000), (1, None, 1, 45000, 45000)]
    core, links = pairing.dependencies(solved, edges)
    found = digraph.strong_components(links, core, solved.select("node", F.col("cluster").alias("part")))
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(0, 45000)]


def test_large_parts_go_without_rounds(spark, monkeypatch):
    """A ring of 60,001 nodes with a tail of 300 that leads to it."""
    monkeypatch.setattr(digraph, "_by_rounds", none)
    monkeypatch.setattr(digraph, "_levels_by_rounds", none)
    ring = spark.range(60_001).select(F.col("id").alias("src"), ((F.col("id") + 1) % 60_001).alias("dst"))
    edges = ring.unionByName(spark.range(300).select((F.lit(60_300) - F.col("id")).alias("src"), (F.when(F.col("id") < 299, F.lit(60_299) - F.col("id")).otherwise(0)).alias("dst")))
    parts = spark.range(60_301).select(F.col("id").alias("node"), F.lit(0).alias("part"))
    found = digraph.strong_components(edges, None, parts)
    assert found.groupBy("component").count().where("count > 1").collect() == [(0, 60_001)] and found.count() == 60_301
    levels = digraph.levels(digraph.condensation(edges, found), None, parts)
    assert levels.where("node = 0").first()["level"] == 300 and levels.count() == 301


def test_shorter_ways_of_responses_equal_the_general_one():
    """The general way is tested against full solutions in ``test_decomposition``."""
    seen = set()
    for seed in range(150):
        rng = np.random.default_rng(seed)
        on = np.flatnonzero(rng.random(64) < 0.7)
        x, y = on % 8, on // 8
        side = (x + y) % 2
        a, b = ((abs(x[:, None] - x) + abs(y[:, None] - y) == 1) & (side[:, None] == 0)).nonzero()
        starts, heads = neighbours(len(on), a, b)
        to = matched(side, starts, heads)
        state = held(to, starts, heads).tolist()
        near, known = Near(starts, heads), {i: j for i, j in enumerate(to.tolist()) if j >= 0}
        reached = Reached([i for i in range(len(on)) if side[i] == 0 and i not in known], near, known)
        for i in range(len(on)):
            assert placed(i, state[i], near, side.tolist(), known, reached) == response(i, near, side.tolist(), known, reached)
            seen.add((int(side[i]), state[i]))
    assert len(seen) == 6


def test_a_cluster_is_dealt_once_a_range_of_its_sites(spark, monkeypatch):
    """A ladder of 2 by 2,500 sites is one task's, not one a thousand sites; in four ranges it gives the same."""
    made = []
    monkeypatch.setattr(responses, "written", lambda df: made.append(df) or df)
    own = spark.createDataFrame([(0, 5_000 * y + x, 0) for x in range(2_500) for y in range(2)], "sample_id int, site long, cluster long")
    vertices, edges = lattice.bipartite_graph(own, 5_000)
    solved = pairing.ground(vertices, edges)
    whole, ranges = (responses.site_responses(solved, edges, *deal) for deal in ((), (1_300,)))
    assert [d.agg(F.max("parts")).first()[0] for d in made] == [1, 4]
    key = lambda d: sorted(tuple(r) for r in d.collect())
    got = key(whole)
    assert len(got) == 5_000 and key(ranges) == got


def test_the_matching_does_not_depend_on_the_order_of_rows(spark):
    """A full lattice has many greatest matchings; the same one is found however its rows arrive."""
    own = spark.range(64).select(F.lit(0).alias("sample_id"), F.col("id").alias("site"), F.lit(0).cast("long").alias("cluster"))
    vertices, edges = lattice.bipartite_graph(own, 8)
    found = []
    for order in (F.col("node"), F.xxhash64("node")):
        solved = pairing.ground(vertices.repartition(1).sortWithinPartitions(order), edges)
        found.append({r["node"]: r["partner"] for r in solved.collect()})
    assert found[0] == found[1] and None not in found[0].values()
