"""Sampled dynamics on periodic lattices: checkerboard half sweeps as one shuffle each, with numbers from a hash."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import discard, written_at
from latticework.operators.lattice import grid_neighbours, parity, uniform


def unit(seed: Column, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    return uniform(seed, key) / F.lit(float(2**32))


def gaussian(seed: Column, key: Column) -> Column:
    """A standard normal number of two uniform ones, in steps of 2^-20, so that sums of it are exact in any order."""
    text = key.cast("string")
    u, v = (uniform(seed, F.concat(text, F.lit(end))) for end in ("a", "b"))
    normal = F.sqrt(-2 * F.log((u + 1) / F.lit(float(2**32)))) * F.cos(F.lit(2 * pi) * v / F.lit(float(2**32)))
    return F.round(normal * 2**20) / 2**20


def bond_key(a: Column, b: Column) -> Column:
    """The key of a bond, the same from both of its ends."""
    return F.concat(F.least(a, b).cast("string"), F.lit("+"), F.greatest(a, b).cast("string"))


def half_sweep(table: DataFrame, length: int, side: int, states: int, coupling: Column, rule: Column) -> DataFrame:
    """``table(sample_id, site, s)`` after one update of all sites on ``side`` of the checkerboard; ``length`` is even.

    Sites of the other side send ``coupling`` (an expression of sample_id, site and the neighbour ``nb``) to their neighbours. ``rule`` gives the new
    state from s and ``w0``, ``w1``, …: the sum of the couplings to neighbours in that state. As no two sites of one side are neighbours, this equals
    their update one after the other. Only these sites and the sums for them are shuffled, both summed on the map side.
    """
    weights = [f"w{q}" for q in range(states)]
    mine = parity(length) == side
    own = table.where(mine).select("sample_id", "site", "s", *[F.lit(0.0).alias(w) for w in weights])
    sent = table.where(~mine).select("sample_id", "site", "s", F.explode(grid_neighbours(length)).alias("nb"))
    sent = sent.select("sample_id", F.col("nb").alias("site"), F.lit(None).cast("int").alias("s"), *[F.when(F.col("s") == q, coupling).otherwise(0.0).alias(w) for q, w in enumerate(weights)])
    sums = own.unionByName(sent).groupBy("sample_id", "site").agg(F.max("s").alias("s"), *[F.sum(w).alias(w) for w in weights])
    return sums.where("s is not null").select("sample_id", "site", rule.cast("int").alias("s")).unionByName(table.where(~mine).select("sample_id", "site", "s"))


def swept(table: DataFrame, length: int, sweeps: int, states: int, coupling: Column, rule: Callable[[int], Column]) -> DataFrame:
    """``table(sample_id, site, s)`` after ``sweeps`` sweeps of two half sweeps; ``rule(t)`` is the rule of half sweep t.

    Each half sweep is written and the one before dropped, so lost executors repeat one half sweep at most. No sites, no rows.
    """
    now, at = written_at(table.select("sample_id", "site", F.col("s").cast("int").alias("s")))
    for t in range(2 * sweeps):
        then, new = written_at(half_sweep(now, length, t % 2, states, coupling, rule(t)))
        discard(table.sparkSession, [at])
        now, at = then, new
    return now
