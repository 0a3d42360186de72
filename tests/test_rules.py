"""The k-core by peeling against plain sets, on hand-made patterns."""

import pytest

from latticework.operators import lattice

SIDE = 6
RING = {(1, 1), (2, 1), (3, 1), (1, 2), (3, 2), (1, 3), (2, 3), (3, 3)}


def _plain(sites, k):
    while True:
        near = lambda x, y: len({((x + a) % SIDE, (y + b) % SIDE) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))} & sites)  # noqa: B023, E731
        less = {s for s in sites if near(*s) >= k}
        if less == sites:
            return sites
        sites = less


@pytest.mark.parametrize("sites", [set(), {(0, 0)}, RING, RING | {(4, 1), (5, 1), (5, 5)}, {(x, 0) for x in range(SIDE)}, {(x, y) for x in range(SIDE) for y in range(SIDE)}])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_k_core(spark, sites, k):
    table = spark.createDataFrame([(0, y * SIDE + x, x, y) for x, y in sorted(sites)], "sample_id int, site long, x long, y long")
    assert {(r["x"], r["y"]) for r in lattice.k_core(table, SIDE, k).collect()} == _plain(sites, k)
