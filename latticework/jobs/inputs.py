"""What several jobs start from: the lattices that the orders define, their active sites, and weights of resampling."""

from __future__ import annotations

from math import exp, factorial, isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import lattice

SAMPLES, DENSITY = 4, 0.25

#: Cumulated probabilities of 0 to 12 events at a rate of one; more than 13 are rarer than a 32-bit number tells.
POISSON = [sum(exp(-1.0) / factorial(j) for j in range(k + 1)) for k in range(13)]


def lattices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Lattices over the order keys: the largest even side that the number of orders fills."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    length = isqrt(orders.count()) // 2 * 2
    low = orders.agg(F.min("o_orderkey")).first()[0] or 0
    return lattice.sites(orders.select((F.col("o_orderkey") - low).alias("site")), "site", length, SAMPLES, DENSITY), length


def active_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """``(sample_id, site, cluster)`` of the active sites of those lattices."""
    table, length = lattices(spark, sf_dir)
    return lattice.clusters(lattice.local_rules(table, length), "active", length), length
