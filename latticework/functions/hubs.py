"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import written

#: A broadcast list of ids has so many at most.
IDS = 2_000_000


def with_hubs_apart(rows: DataFrame, by_key: DataFrame, key: str, count: str, total: int, least: int = 256, hubs: int = 10_000) -> DataFrame:
    """``rows`` inner-joined to ``by_key`` (one row a key, ``count`` of its rows) on ``key``, without ``count``.

    Keys with more than ``total / hubs`` rows (and more than ``least``) are broadcast, at most ``hubs`` of them, so that
    their rows stay where they are; all others are shuffled and have no more rows than that. ``total`` is the number of ``rows``.
    Null keys match nothing.
    """
    limit = max(least, total // hubs)
    often = F.broadcast(by_key.where(F.col(count) > limit).drop(count))
    rest = rows.join(often.select(key), key, "left_anti").join(by_key.where(F.col(count) <= limit).drop(count), key)
    return rows.join(often, key).unionByName(rest)


def listed(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``key`` is among ``ids`` (or isn't, ``how`` being left_anti).

    The different ids are written and counted; up to IDS of them are broadcast, so that wide rows stay where they are; more are joined by a shuffle.
    """
    ids = written(ids.select(key).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, key, how)
