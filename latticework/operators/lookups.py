"""Values from a cache or from the nearest point, with errors that name what is missing or not unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import written


def _refuse(rows: DataFrame, columns: list[str], what: str, shown: int = 5) -> None:
    """ValueError with the number of ``rows`` and the first few keys, if there are any."""
    few = rows.select(*columns).orderBy(*columns).limit(shown).collect()
    if few:
        raise ValueError(f"{rows.count()} {what}, first: {[tuple(r) for r in few]}")


def looked_up(rows: DataFrame, cache: DataFrame, keys: list[str], value: str, fallback: str | None = None, strict: bool = False) -> DataFrame:
    """``rows`` with ``value`` from ``cache(*keys, value)``; where it is missing or null the column ``fallback`` of ``rows``, or null.

    ``strict`` raises ValueError with the missing keys instead. A key that occurs more than once in the cache raises as well, since rows would multiply. Null keys match nothing.
    """
    _refuse(cache.groupBy(*keys).count().where("count > 1"), keys, "keys are in the cache more than once")
    found = rows.join(cache.select(*keys, F.col(value).alias("_found")), keys, "left")
    if strict:
        found = written(found)
        _refuse(found.where("_found is null").select(*keys).distinct(), keys, "keys are missing")
    filled = F.coalesce("_found", F.col(fallback)) if fallback else F.col("_found")
    kept = [c for c in rows.columns if c != value]
    return found.select(*kept, filled.alias(value))


def nearest_target(raw: DataFrame, targets: DataFrame, keys: list[str], value: str, tolerance: float, strict: bool = True) -> DataFrame:
    """``raw`` with ``target``: the value of ``targets(*keys, value)`` with equal keys that lies nearest, at most ``tolerance`` off; the lower of two equally near ones; null where there is none.

    An equi-join on keys and cells of twice the tolerance: a raw value looks into the two cells that its surroundings touch. ``strict`` raises ValueError where two raw rows have
    one target (duplicates) and where a target has none (missing); raw values without a target are no error. Null keys and values match nothing.
    """
    own = written(raw.withColumn("_row", F.monotonically_increasing_id()))
    width = 2 * tolerance
    cell = lambda v: F.floor(v / width).cast("long")
    looking = own.select("_row", *keys, F.col(value).alias("_raw"), F.explode(F.array_distinct(F.array(cell(F.col(value) - tolerance), cell(F.col(value) + tolerance)))).alias("_cell"))
    near = looking.join(targets.select(*keys, F.col(value).alias("target"), cell(F.col(value)).alias("_cell")).distinct(), [*keys, "_cell"])
    gap = F.abs(F.col("_raw") - F.col("target"))
    best = near.where(gap <= tolerance).groupBy("_row").agg(F.min(F.struct(gap.alias("gap"), "target"))["target"].alias("target"))
    found = written(own.join(best, "_row", "left"))
    if strict:
        used = found.where("target is not null").groupBy(*keys, "target").count()
        _refuse(used.where("count > 1"), [*keys, "target"], "targets have more than one value")
        wanted = targets.select(*keys, F.col(value).alias("target")).distinct()
        _refuse(wanted.join(used, [*keys, "target"], "left_anti"), [*keys, "target"], "targets have no value")
    return found.select(*raw.columns, "target")
