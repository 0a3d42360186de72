"""The Dirichlet fit against the likelihood itself."""

from math import lgamma

import numpy as np

from latticework.jobs import registry
from latticework.operators import fits


def test_dirichlet_is_likeliest(spark):
    rng, truth = np.random.default_rng(5), {1: (0.6, 2.0, 5.0), 2: (30.0, 20.0, 9.0), 3: (0.3, 0.2, 0.4)}
    data = {g: rng.dirichlet(a, 400) for g, a in truth.items()}
    rows = [(g, *map(float, p)) for g, own in data.items() for p in own] + [(4, 0.2, 0.3, 0.5), (5, None, 0.5, 0.5), (6, 1.0, 0.0, 0.0), (6, 1.0, 0.0, 0.0)]
    got = {r["g"]: r for r in fits.dirichlet(spark.createDataFrame(rows, "g int, a double, b double, c double"), ["g"], ["a", "b", "c"]).collect()}
    assert set(got) == {1, 2, 3, 4, 6} and got[1]["n"] == 400 and got[4]["alpha_a"] is None and got[6]["alpha_b"] is None
    for g, own in data.items():
        logs = np.log(np.clip(own, 1e-10, 1 - 1e-10)).mean(0)
        likely = lambda a: lgamma(sum(a)) - sum(map(lgamma, a)) + float(((np.array(a) - 1) * logs).sum())
        best = np.array([got[g][f"alpha_{c}"] for c in "abc"])
        assert np.all(np.abs(best / truth[g] - 1) < 0.35)
        for i in range(3):
            for d in (0.99, 1.01):
                moved = best.copy()
                moved[i] *= d
                assert likely(moved) < likely(best)


def test_nothing_and_query(spark):
    assert fits.dirichlet(spark.createDataFrame([], "g int, a double, b double"), ["g"], ["a", "b"]).count() == 0
    rows = registry.QUERIES["dirichlet_by_segment"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 5 and all(r["alpha_a"] > 0 for r in rows)
