"""Shards of near-equal size: longest-processing-time scheduling of groups of equal texts."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import written
from latticework.functions.hubs import with_hubs_apart


#: Rows of a driver's table that are still broadcast, of some 100 bytes each; beyond, it is shuffled.
MOST_BROADCAST = 500_000


def longest_first(classes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """How many groups of each class ``(size, number of groups)`` go to each shard.

    Groups are dealt out by size, largest first, each to the least-loaded shard. Many groups of one size are dealt out
    at once: as many whole rounds as surely go to the least-loaded ones alike, then one by one through the heap.
    """
    load = [0] * shards
    dealt: dict[int, list[int]] = {}
    for size, number in sorted(classes, reverse=True):
        took = [0] * shards
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        while number:
            low = [x for x, _ in heap if x < heap[0][0] + size]  # these are level: each round gives every one of them a group
            above = min((x for x, _ in heap if x >= heap[0][0] + size), default=None)
            rounds = number // len(low) if above is None else min(number // len(low), (above - max(low)) // size)
            if rounds > 1:
                level = heap[0][0] + size
                took = [t + (rounds - 1) * (load[s] < level) for s, t in enumerate(took)]
                heap = [(x + (rounds - 1) * size * (x < level), s) for x, s in heap]
                heapq.heapify(heap)
                number -= (rounds - 1) * len(low)
                for x, s in heap:
                    load[s] = x
                continue
            x, s = heapq.heappop(heap)
            took[s] += 1
            number -= 1
            heapq.heappush(heap, (x + size, s))
            load[s] = x + size
        dealt[size] = took
    return dealt


def _ranked(table: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """``table`` written with ``part`` and ``nth`` (from 0 in its part), and ``(keys, part, n)``: how many rows a part has of each key.

    Rows are dealt to parts by ranges of ``keys`` and ``order``, so that no key's rows need be in one task.
    """
    parts = written(table.repartitionByRange(*keys, order).select("*", F.spark_partition_id().alias("part")))
    nth = F.expr(f"row_number() over (partition by part, {', '.join(keys)} order by {order})") - 1
    return parts.withColumn("nth", nth.cast("long")), parts.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """``(g, shard)`` for ``groups(g, size)``, in longest-processing-time order.

    The driver gets one row for each different size and part that has it. Sizes that differ add up to at least half the square of their number, so there are fewer than the
    square root of twice all bytes. Of groups of one size, which one goes where is their rank by ``g``.
    """
    spark = groups.sparkSession
    ranked, counts = _ranked(groups.select("g", F.col("size").alias("cls")), ["cls"], "g")
    counts = sorted((r["cls"], r["part"], r["n"]) for r in counts.collect())
    total: dict[int, int] = {}
    starts = []
    for cls, part, n in counts:
        starts.append((cls, part, total.get(cls, 0)))
        total[cls] = total.get(cls, 0) + n
    dealt = longest_first(list(total.items()), shards)
    bounds = {cls: [sum(took[: s + 1]) for s in range(shards)] for cls, took in dealt.items()}
    to = spark.createDataFrame([(cls, part, first, bounds[cls]) for cls, part, first in starts] or [(0, 0, 0, [0])], "cls long, part int, first long, bounds array<long>")
    placed = ranked.join(F.broadcast(to) if len(starts) <= MOST_BROADCAST else to, ["cls", "part"])
    shard = F.size(F.filter("bounds", lambda b: b <= F.col("first") + F.col("nth")))
    return placed.select("g", shard.cast("int").alias("shard"))


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row ``(doc_id, size, text_crc32, shard, slot)`` for each row of ``docs``.

    Size is the UTF-8 bytes of the text (null: none) and 1. Rows of equal text (null and empty are equal) stay
    together. Their groups, by their summed sizes, largest first, go to the least-loaded shard. Slots count gapless from 0 in each shard, in no given order. Only ids, sizes and
    hashes are shuffled, never texts. A null doc_id is an id like any other; repeated rows have their own
    slots; other columns are ignored; empty in, empty out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("g")))
    groups = written(rows.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    to = written(group_shards(groups, shards)).join(groups.select("g", "n"), "g")
    placed = with_hubs_apart(rows, to, "g", "n", rows.count())
    parts = written(placed.select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = sorted((r["shard"], r["part"], r["n"]) for r in parts.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).collect())  # at most shards rows a part
    starts, total = [], {}
    for shard, part, n in counts:
        starts.append((shard, part, total.get(shard, 0)))
        total[shard] = total.get(shard, 0) + n
    start = spark.createDataFrame(starts or [(0, 0, 0)], "shard int, part int, first long")
    nth = F.expr("row_number() over (partition by shard, part order by at)") - 1
    out = parts.withColumn("nth", nth).join(F.broadcast(start), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def sharded(docs: DataFrame, text_col: str = "text", shards: int = 8) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (a column of that name is replaced), for ``write.partitionBy("shard")``; texts are shuffled once."""
    key = "_g"
    while key in docs.columns:
        key += "_"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.drop("shard").withColumn(key, F.xxhash64(text, F.octet_length(text)))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    groups = written(marked.select(F.col(key).alias("g"), size.alias("size")).groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    to = written(group_shards(groups, shards)).join(groups.select("g", "n"), "g").select(F.col("g").alias(key), "shard", F.col("n").alias(f"{key}n"))
    return with_hubs_apart(marked, to, key, f"{key}n", docs.count()).drop(key)
