"""Autocorrelation times and convergence against plain loops, on series of one, two, equal and many values."""

import datetime
import math
import random
import statistics

import pytest

from latticework.jobs import series


def plain(x):
    """(acf up to the limit, Sokal's tau and window, Geyer's tau and window, convergence) of one series."""
    n = len(x)
    d = [v - sum(x) / n for v in x]
    cap = max(1, n // 10)
    g = [sum(a * b for a, b in zip(d, d[k:])) / n for k in range(min(n, cap + 1))]
    acf = [1.0] + [0.0 if abs(g[0]) < 1e-6 else v / g[0] for v in g[1:]]
    sokal, total = (1.0, 0), 0.0
    for m in range(1, len(acf)):
        total += acf[m]
        sokal = (max(1.0, 1 + 2 * total), m)
        if m >= 5 * sokal[0]:
            break
    total, last, least = (acf[1], 0, math.inf) if n > 1 else (0.0, 0, 0)
    for k in range(len(acf) // 2):
        least = min(least, acf[2 * k] + acf[2 * k + 1])
        if least <= 0:
            break
        last = k
        total += least if k else 0
    geyer = (max(1.0, 1 + 2 * total), min(cap, 2 * last + 1) if n > 1 else 0)
    w = min(50, n)
    means = [sum(x[j - w : j]) / w for j in range(w, n + 1)]
    ref = statistics.median(means[-min(len(means), max(5, math.ceil(len(means) * 0.1))) :])
    near = [w + j for j, v in enumerate(means) if abs(v - ref) <= max(1e-12, 0.01 * max(1.0, abs(ref)))]
    return acf, sokal, geyer, near[0] if near else n


def test_series_of_all_kinds(spark, tmp_path):
    rng = random.Random(4)
    walk = [0.0]
    for _ in range(400):
        walk.append(0.9 * walk[-1] + rng.gauss(0, 1))
    chains = {1: [3.0], 2: [1.0, 5.0], 3: [2.0] * 30, 4: walk, 5: [float((-1) ** i) for i in range(120)], 6: [rng.random() for _ in range(55)]}
    start = datetime.datetime(2020, 1, 1)
    rows = [(c * 1000 + i, start + datetime.timedelta(seconds=i), c, v) for c, x in chains.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    by = lambda name: {r["c"]: r for r in series.QUERIES[name](spark, str(tmp_path)).collect()}
    sokal, geyer, moving = by("sokal_tau"), by("geyer_pairs"), by("moving_average_convergence")
    acf = {(r["c"], r["lag"]): r["rho"] for r in series.acf_lags(spark, str(tmp_path)).collect()}
    for c, x in chains.items():
        own, (t1, m1), (t2, m2), first = plain(x)
        assert [acf[c, k] for k in range(len(own))] == pytest.approx(own, abs=1e-8)
        assert sokal[c]["tau"] == pytest.approx(t1, abs=1e-6) and sokal[c]["window_m"] == m1
        assert geyer[c]["tau"] == pytest.approx(t2, abs=1e-6) and geyer[c]["window_m"] == m2
        assert moving[c]["first_i"] == first
