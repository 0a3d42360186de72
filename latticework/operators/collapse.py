"""Collapse of curves of several sizes onto one: exponents and critical point by a projected gradient fit, one start of one draw a task.

``p = l^-c2 * F((rho - rho_c) * l^c1)`` with ``l = L / L_max``, and with the first-order correction ``p = l^-c2 * (F(x) + (L / L_min)^-omega * G(x))``. F and G are Chebyshev polynomials: for
given exponents they are a linear least-squares problem, so only the exponents are searched, by damped Gauss-Newton steps on the residuals that are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_over(theta: np.ndarray, size: np.ndarray, rho: np.ndarray, p: np.ndarray, sigma: np.ndarray, degree: int) -> np.ndarray:
    """What the best curve for ``theta`` (rho_c, log c1, c2 and, with the correction, log omega) leaves, in units of ``sigma``."""
    own = size / size.max()
    x = (rho - theta[0]) * own ** np.exp(theta[1])
    basis = np.polynomial.chebyshev.chebvander(x / max(np.abs(x).max(), 1e-300), degree)
    if len(theta) > 3:
        basis = np.hstack([basis, basis[:, : max(2, degree // 2)] * ((size / size.min()) ** -np.exp(theta[3]))[:, None]])
    a = basis * (own ** -theta[2] / sigma)[:, None]
    width = np.linalg.norm(a, axis=0)
    a = a / np.where(width > 0, width, 1)
    return p / sigma - a @ np.linalg.lstsq(a, p / sigma, rcond=1e-12)[0]


def fitted(start: np.ndarray, size: np.ndarray, rho: np.ndarray, p: np.ndarray, sigma: np.ndarray, degree: int, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """The exponents that ``start`` leads to, half the sum of squares there, and their standard errors."""
    of = lambda t: left_over(t, size, rho, p, sigma, degree)
    theta, damp = start.astype(float), 1e-2
    r = of(theta)
    loss = r @ r

    def slopes(t: np.ndarray) -> np.ndarray:
        step = 1e-6 * np.maximum(1, np.abs(t))
        return np.stack([(of(t + s) - of(t - s)) / (2 * h) for s, h in zip(np.diag(step), step)], axis=1)

    for _ in range(rounds):
        j = slopes(theta)
        square, down, moved = j.T @ j, j.T @ r, False
        while damp < 1e12:
            move = np.linalg.lstsq(square + damp * np.diag(np.maximum(np.diag(square), 1e-12)), -down, rcond=None)[0]
            new = theta + np.clip(move, -1, 1)
            after = of(new)
            if np.isfinite(after @ after) and after @ after < loss:
                gain, theta, r, loss, damp, moved = loss - after @ after, new, after, after @ after, damp / 5, True
                break
            damp *= 4
        if not moved or gain <= 1e-12 * loss:
            break
    j = slopes(theta)
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(j.T @ j)), 0))
    return theta, loss / 2, error


def guess(size: np.ndarray, rho: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Start: the steepest place of the largest size's curve, c1 of 1, c2 of 0.1."""
    own = size == size.max()
    order = np.argsort(rho[own])
    x, y = rho[own][order], p[own][order]
    if len(x) < 2:
        return np.array([x.mean(), 0.0, 0.1])
    k = int(np.argmax(np.abs(np.diff(y)) / np.maximum(np.diff(x), 1e-300)))
    return np.array([(x[k] + x[k + 1]) / 2, 0.0, 0.1])


def collapse(points: DataFrame, group: list[str], starts: int = 6, draws: int = 0, degree: int = 6, correction: bool = False, floor: float = 1e-12) -> DataFrame:
    """``(*group, draw, start, n, loss, rho_c, c1, c2, omega, rho_c_error, c1_error, c2_error, omega_error)`` for each start of each draw of ``points(*group, l, rho, p, sigma)``.

    Draw 0 is the data, the others add normal noise of ``sigma`` (at least ``floor``) from a generator of the draw's own number; start 0 is ``guess``, the others move it. Points with null or non-finite numbers or a size that isn't positive are left out;
    a group with fewer points than unknowns, or with one size only, has no rows. A task holds the summary points of one group (one a size and density, not samples) for one
    start of one draw. omega is null without ``correction``; the best start has the least loss.
    """
    kinds = dict(points.dtypes)
    fine = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")) for c in ("l", "rho", "p", "sigma")]
    good = points.where(fine[0] & fine[1] & fine[2] & fine[3] & (F.col("l") > 0)).select(*group, *[F.col(c).cast("double").alias(c) for c in ("l", "rho", "p", "sigma")])
    work = good.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    names = ["rho_c", "c1", "c2", "omega"]
    columns = [*group, "draw", "start", "n", "loss", *names, *[f"{c}_error" for c in names]]

    def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["l", "rho", "p", "sigma"])
        draw, start = int(key[-2]), int(key[-1])
        size, rho, p, sigma = (own[c].to_numpy() for c in ("l", "rho", "p", "sigma"))
        sigma = np.maximum(sigma, floor)
        unknown = degree + 1 + (3 if not correction else 4 + max(2, degree // 2))
        if len(p) <= unknown or len(np.unique(size)) < 2:
            return pd.DataFrame(columns=columns)
        if draw:
            p = p + sigma * np.random.default_rng([11, draw]).standard_normal(len(p))
        first = guess(size, rho, p)
        if correction:
            first = np.append(first, 0.0)
        if start:
            spread = np.array([0.1 * (rho.max() - rho.min()), 0.5, 0.3, 0.7])[: len(first)]
            first = first + spread * np.random.default_rng([13, draw, start]).uniform(-1, 1, len(first))
        theta, loss, error = fitted(first, size, rho, p, sigma, degree)
        c1, omega = np.exp(theta[1]), np.exp(theta[3]) if correction else None
        errors = [error[0], c1 * error[1], error[2], omega * error[3] if correction else None]
        return pd.DataFrame([[*key, len(p), loss, theta[0], c1, theta[2], omega, *errors]], columns=columns)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in group], "draw int, start int, n long, loss double", *[f"{c} double" for c in names], *[f"{c}_error double" for c in names]])
    return work.groupBy(*group, "draw", "start").applyInPandas(solve, schema)


def best_starts(fits: DataFrame, group: list[str]) -> DataFrame:
    """Of each group and draw the start of least loss, the first of equal ones."""
    keys = [*group, "draw"]
    rest = [c for c in fits.columns if c not in keys]
    return fits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("loss", "start")).alias("best")).select(*keys, "best.*")


def in_short(value, error):
    """A number with its error in units of the last digit, as in ``0.5927(12)``: two digits of the error, null without a positive error."""
    digits = F.greatest(F.lit(0), 1 - F.floor(F.log10(error))).cast("int")
    scaled = F.round(error * F.pow(F.lit(10.0), digits)).cast("long").cast("string")
    shown = F.coalesce(*[F.when(digits == k, F.format_string(f"%.{k}f", value)) for k in range(13)])
    return F.when(error > 0, F.concat(shown, F.lit("("), scaled, F.lit(")")))


def over_draws(best: DataFrame, group: list[str], names: tuple[str, ...] = ("rho_c", "c1", "c2")) -> DataFrame:
    """By group: number of draws beyond draw 0, and of each name draw 0's value, mean and deviation over the draws, their 2.5 and 97.5 percentiles, and value with deviation ``in_short``."""
    drawn = lambda c: F.when(F.col("draw") > 0, F.col(c))
    out = [F.count_if(F.col("draw") > 0).alias("draws")]
    for c in names:
        out += [F.max(F.when(F.col("draw") == 0, F.col(c))).alias(c), F.avg(drawn(c)).alias(f"{c}_mean"), F.stddev_samp(drawn(c)).alias(f"{c}_sd"), F.percentile(drawn(c), F.lit(0.025)).alias(f"{c}_low"), F.percentile(drawn(c), F.lit(0.975)).alias(f"{c}_high")]
    sums = best.groupBy(*group).agg(*out)
    return sums.select("*", *[in_short(F.col(c), F.col(f"{c}_sd")).alias(f"{c}_short") for c in names])
