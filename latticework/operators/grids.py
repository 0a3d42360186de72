"""Grids of parameters as array columns, to be exploded: each depends on its row's parameters alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _upto(n: Column) -> Column:
    """0 to n - 1; empty where n is null or less than one."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def linspace(low: Column, high: Column, n: Column) -> Column:
    """``n`` equally spaced values with both ends; of one value only ``low``."""
    return F.transform(_upto(n), lambda i: low + i * F.when(n > 1, (high - low) / (n - 1)).otherwise(0.0))


def arithmetic(start: Column, step: Column, end: Column, slack: float = 1e-9) -> Column:
    """``start``, ``start + step``, ... as far as ``end``, which may be passed by ``slack``; empty where the step is 0 or leads away."""
    count = F.floor((F.abs(end - start) + slack) / F.nullif(F.abs(step), F.lit(0.0))) + 1
    leads = (end - start) * step >= 0
    return F.transform(_upto(F.when(leads, F.coalesce(count, F.lit(0)))), lambda i: start + i * step)


def concentrated(low: Column, high: Column, centre: Column, n: Column, power: Column) -> Column:
    """At most ``n`` values between ``low`` and ``high`` (passed by 1e-9 at most), the closer to ``centre`` the denser (``power`` above 1): rounded to six digits, each once, ascending."""
    width = F.greatest(F.abs(low - centre), F.abs(high - centre))
    t = F.transform(_upto(n), lambda i: 2 * i / (n - 1) - 1)
    values = F.transform(t, lambda x: centre + F.signum(x) * F.pow(F.abs(x), power) * width)
    return F.array_sort(F.array_distinct(F.transform(F.filter(values, lambda v: (v >= low - 1e-9) & (v <= high + 1e-9)), lambda v: F.round(v, 6))))


def dense(low: Column, high: Column, n: Column, dense_low: Column, dense_high: Column, dense_n: Column) -> Column:
    """``n`` values ascending, ``dense_n`` of them inside ``dense_low`` to ``dense_high``, the rest over the two outer parts by length, with all four ends and at least two a part.

    Where the dense part is null, negative or empty all are equally spaced.
    """
    left, right, outer = dense_low - low, high - dense_high, n - dense_n
    share = F.greatest(F.lit(2.0), F.round(outer * left / F.nullif(left + right, F.lit(0.0))))
    first = F.when(outer - share < 2, outer - 2).otherwise(share).cast("int")
    inside = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), dense_n.cast("int"))), lambda i: dense_low + i * (dense_high - dense_low) / (dense_n + 1))
    parts = F.concat(linspace(low, dense_low, first), linspace(dense_high, high, outer - first), inside)
    off = F.coalesce((dense_low < 0) | (dense_high < 0) | (dense_n <= 0), F.lit(True))
    return F.when(off, linspace(low, high, n)).otherwise(F.array_sort(parts))
