"""Fits whose data enter by sums: Spark adds these up, a task solves one small system a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _psi(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logarithm of the gamma function, by recurrence up to 10 and the series from there."""
    x, first, second = np.array(x, float), 0.0, 0.0
    for _ in range(10):
        first, second, x = first - 1 / x, second + 1 / x**2, x + 1
    r = 1 / x**2
    return first + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252)), second + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r / 42))


def likeliest(mean: np.ndarray, variance: np.ndarray, logs: np.ndarray, rounds: int = 200) -> np.ndarray | None:
    """Parameters of the likeliest Dirichlet law of shares with these means, variances and mean logarithms; None where there is none.

    Newton steps from the estimate by moments, halved until all parameters stay positive. Shares that don't vary have no finite parameters.
    """
    if not np.all(variance > 1e-15):
        return None
    a = np.clip(mean * (mean * (1 - mean) / np.maximum(variance, 1e-10) - 1), 0.1, 100)
    for _ in range(rounds):
        (all_, all2), (each, each2) = _psi(a.sum()), _psi(a)
        slope, bend = all_ - each + logs, -each2
        step = (slope - (slope / bend).sum() / (1 / all2 + (1 / bend).sum())) / bend
        while np.any(a - step <= 0):
            step = step / 2
        a = a - step
        if np.max(np.abs(step) / a) < 1e-12:
            break
    return a


def dirichlet(table: DataFrame, group: list[str], shares: list[str], least: float = 1e-10) -> DataFrame:
    """``(*group, n, alpha_<share>…)``: the likeliest Dirichlet law of the rows' ``shares`` in each group.

    Shares are held between ``least`` and 1 - ``least`` before their logarithm. Rows with a null share are left out; groups whose shares don't vary
    get null parameters; no rows, no groups. One partial aggregate; a group comes to a task as one row of sums.
    """
    own = table.dropna(subset=shares)
    held = lambda c: F.log(F.greatest(F.lit(least), F.least(F.lit(1 - least), F.col(c))))
    kinds = ((F.avg, "m"), (F.var_pop, "v"))
    sums = own.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for f, k in kinds for c in shares], *[F.avg(held(c)).alias(f"l_{c}") for c in shares])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = lambda k: rows[[f"{k}_{c}" for c in shares]].to_numpy(float)
            found = [likeliest(*x) for x in zip(at("m"), at("v"), at("l"))]
            out = rows[[*group, "n"]].copy()
            for i, c in enumerate(shares):
                out[f"alpha_{c}"] = [None if a is None else float(a[i]) for a in found]
            yield out

    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    return sums.mapInPandas(solve, ", ".join([*(f"{g} {types[g]}" for g in group), "n long", *(f"alpha_{c} double" for c in shares)]))
