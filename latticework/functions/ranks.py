"""Exact numbers of rows in an order, without one task that holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions.durable import written


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """``rows`` with ``name``: the number (from 0) of a row in ``order`` among those with equal ``keys``.

    Rows are dealt to tasks by ranges of keys and order, numbered there, and moved on by the rows that earlier tasks have of their key: a window
    over at most one row a key and task. ``order`` should tell all rows of a key apart; rows that it doesn't tell apart get different numbers in any order. Null keys are a key of their own.
    """
    at, part, many, first = f"{name}_at", f"{name}_part", f"{name}_n", f"{name}_first"
    table = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id()))
    table = table.withColumn(part, F.shiftright(at, 33))
    counts = table.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(many), F.min(at).alias(first))
    before = F.sum(many).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.col(part).alias(f"{part}_"), (F.coalesce(before, F.lit(0)) - F.col(first)).alias(f"{name}_move"))
    same = F.col(part) == F.col(f"{part}_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
    return table.join(moved, same).withColumn(name, F.col(at) + F.col(f"{name}_move")).select(*rows.columns, name)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """``(*keys, name, n)``: the value of rank ``floor(q * (n - 1))``, from 0, among the ``n`` values of a key that aren't null: a value that occurs, never one between two.

    Values are numbered by ranges, so no task and no list holds all of a key's; a key without values has no row.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    own = rows.select(*keys, F.col(value).alias(name)).where(F.col(name).isNotNull())
    counts = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(k).alias(f"{k}_") for k in keys], "n", F.floor(F.lit(q) * (F.col("n") - 1)).alias("rank"))
    same = F.col("place") == F.col("rank")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return numbered(own, keys, [name]).join(counts, same).select(*keys, name, "n")
