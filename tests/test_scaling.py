"""Collapse fits on planted exponents, autocorrelation by blocks, and ranks, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions.ranks import nearest_rank
from latticework.jobs.series import autocorrelation
from latticework.operators import collapse

SCHEMA = "curve string, l int, rho double, p double, sigma double"


def planted(curve, rho_c, c1, c2, omega=None, noise=1e-3, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for size in (16, 32, 64, 128):
        for rho in np.linspace(rho_c - 0.12, rho_c + 0.1, 21):
            x, own = (rho - rho_c) * (size / 128) ** c1, size / 128
            f = 1 / (1 + np.exp(-18 * x))
            if omega:
                f += (size / 16) ** -omega * (0.3 + 0.8 * x)
            rows.append((curve, size, float(rho), float(own**-c2 * f + noise * rng.standard_normal()), noise))
    return rows


def test_planted_exponents_come_back(spark):
    rows = planted("a", 0.59, 0.75, 0.104) + planted("b", 0.31, 1.14, 0.48, seed=1) + [("a", None, 0.5, 1.0, 0.1), ("a", 16, 0.5, float("nan"), 0.1), ("few", 16, 0.5, 1.0, 0.1), ("few", 32, 0.5, 1.0, 0.1)]
    points = spark.createDataFrame(rows, SCHEMA).withColumn("loss", F.lit("clash")).repartition(3)
    fits = collapse.collapse(points, ["curve"], starts=3, draws=8, degree=8)
    assert fits.groupBy("curve").count().orderBy("curve").collect() == [("a", 27), ("b", 27)]
    best = collapse.best_starts(fits, ["curve"])
    assert best.count() == 18 and best.columns[:2] == ["curve", "draw"]
    for r in best.where("draw = 0").collect():
        want = {"a": (0.59, 0.75, 0.104), "b": (0.31, 1.14, 0.48)}[r["curve"]]
        assert r["n"] == 84 and r["omega"] is None
        for name, value in zip(("rho_c", "c1", "c2"), want):
            assert abs(r[name] - value) < 4 * r[f"{name}_error"] and r[f"{name}_error"] < 0.02
    for r in collapse.over_draws(best, ["curve"]).collect():
        assert r["draws"] == 8 and r["c1_low"] <= r["c1_mean"] <= r["c1_high"] and 0.2 < r["c1_sd"] / 0.0025 < 5
        assert r["c1_short"].startswith(f"{r['c1']:.4f}") and r["c1_short"].endswith(")")


def test_first_order_correction(spark):
    points = spark.createDataFrame(planted("a", 0.59, 0.75, 0.104, 0.9, 3e-4), SCHEMA)
    found = {c: collapse.best_starts(collapse.collapse(points, ["curve"], starts=4, degree=8, correction=c), ["curve"]).first() for c in (False, True)}
    assert found[True]["loss"] < found[False]["loss"] / 100
    for name, value in (("rho_c", 0.59), ("c1", 0.75), ("c2", 0.104), ("omega", 0.9)):
        assert abs(found[True][name] - value) < 4 * found[True][f"{name}_error"]


def test_fits_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    fits = collapse.collapse(none, ["curve"])
    assert fits.count() == 0 and collapse.over_draws(collapse.best_starts(fits, ["curve"]), ["curve"]).count() == 0


def test_numbers_in_short(spark):
    rows = [(0.59271, 0.0012), (12.3456, 0.5), (3.0, 0.0), (1234.5, 25.0), (None, 0.1)]
    got = [r[0] for r in spark.createDataFrame(rows, "v double, e double").select(collapse.in_short(F.col("v"), F.col("e"))).collect()]
    assert got[:4] == ["0.5927(12)", "12.35(50)", None, "1234(25)"] or got[:4] == ["0.5927(12)", "12.35(50)", None, "1235(25)"]


@pytest.mark.parametrize("block", [4, 7, 1 << 14])
def test_autocorrelation_by_blocks(spark, block):
    rng = random.Random(block)
    chains = {c: [rng.gauss(0, 1) for _ in range(n)] for c, n in ((1, 1), (2, 2), (3, 9), (4, 40), (5, 333))} | {6: [2.0] * 30}
    rows = [(c, i + 1, x) for c, own in chains.items() for i, x in enumerate(own)]
    rng.shuffle(rows)
    got = {(r["c"], r["lag"]): r["rho"] for r in autocorrelation(spark.createDataFrame(rows, "c long, i long, x double"), block).collect()}
    want = {}
    for c, own in chains.items():
        d = np.array(own) - np.mean(own)
        g = [float(d[: len(d) - k] @ d[k:]) / len(d) for k in range(min(len(d) - 1, max(1, len(d) // 10)) + 1)]
        want |= {(c, k): 1.0 if k == 0 else 0.0 if abs(g[0]) < 1e-6 else v / g[0] for k, v in enumerate(g)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_rank(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice([None, float(rng.randint(0, 20)), rng.random()])) for _ in range(400)] + [(None, 1.0), ("z", None)]
    table = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r["k"]: (r["quantile"], r["n"]) for r in nearest_rank(table, ["k"], "v", q).collect()}
        own = {k: sorted(v for j, v in rows if j == k and v is not None) for k in ("a", "b", None)}
        assert got == {k: (v[int(q * (len(v) - 1))], len(v)) for k, v in own.items()}
    with pytest.raises(ValueError):
        nearest_rank(table, ["k"], "v", 1.5)
