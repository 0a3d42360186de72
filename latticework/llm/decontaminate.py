"""Benchmark decontamination: a broadcast set of test n-grams against every token window."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import Growing, written
from latticework.llm.spans import merged, replaced

#: A-Z in lower case, other ASCII that is no letter or digit as a blank, the rest as it is.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: At most so many bytes of items are broadcast at once; more are worked off in slices. A byte of items takes about ten in a worker's index.
SLICE_BYTES = 32 << 20

SPANS = "array<struct<start:int,end:int,first:int,last:int>>"
CONTINUED = bytes(range(0x80, 0xC0))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class WindowIndex:
    """The windows of a set of items, by length in words.

    All items' word ids lie in one array; a window is a hash, the place where it begins and the number of its item,
    in arrays sorted by hash: some 20 bytes a window.
    """

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = np.array([item for item, _ in items], np.int64)
        known = self.vocabulary
        each = [np.array([known.setdefault(w, len(known) + 1) for w in words_of(text)], np.uint32) for _, text in items]
        self.ids = np.concatenate([*each, np.empty(0, np.uint32)])
        starts = np.cumsum([0, *map(len, each)])
        parts: dict[int, list] = {}
        for i, own in enumerate(each):
            if n := min(width, len(own)):
                at = np.arange(len(own) - n + 1)
                parts.setdefault(n, []).append((self.rolled(own, n), starts[i] + at, np.full(len(at), i)))
        self.by_length = {}
        for n, found in parts.items():
            h, at, item = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            self.by_length[n] = h[order], at[order].astype(np.uint32), item[order].astype(np.uint32)

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each window of ``n`` ids."""
        ids = ids.astype(np.uint64)
        h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
        for k in range(n):
            h = (h ^ ids[k : k + len(h)]) * MIX
            h ^= h >> np.uint64(29)
        return h

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words inside occurring windows, and the items they belong to."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words))
        spans, items = [], set()
        gaps = np.r_[0, np.cumsum(ids == 0)]
        for n, (hashes, places, owners) in self.by_length.items():
            if len(ids) < n:
                continue
            full = np.flatnonzero(gaps[n:] == gaps[:-n])  # windows without a word that no item has
            if not len(full):
                continue
            h = self.rolled(ids, n)[full]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for at, a, b in zip(full[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                same = (self.ids[places[a:b, None] + np.arange(n, dtype=np.uint32)] == ids[at : at + n]).all(axis=1)  # equal hashes may be of other words
                if same.any():
                    spans.append((at, at + n))
                    items.update(self.items[owners[a:b][same]].tolist())
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def index_of_worker(key: str, items: list[tuple], width: int) -> WindowIndex:
    """The index that this Python process keeps for its later tasks, one at a time."""
    import sys
    import types

    kept = sys.modules.setdefault("_window_index", types.ModuleType("_window_index"))
    if getattr(kept, "key", None) != key:
        kept.index, kept.key = None, None
        kept.index, kept.key = WindowIndex(items, width), key
    return kept.index


def places(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """The word spans with the code points where they begin and end."""
    if not spans:
        return []
    word = [m.span() for m in re.finditer(rb"\S+", text.translate(FOLD))]
    out, at, points = [], 0, 0
    for a, b in spans:
        first, last = word[a][0], word[b - 1][1]
        begin = points + len(text[at:first].translate(None, CONTINUED))
        at, points = last, begin + len(text[first:last].translate(None, CONTINUED))
        out.append({"start": a, "end": b, "first": begin, "last": points})
    return out


def _scan(docs: DataFrame, items: list[tuple], width: int) -> tuple[DataFrame, Broadcast]:
    """``docs`` with their hits, and the broadcast that their tasks read."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    pair = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "first", "last")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of_worker(key, shared.value, width)
        for b in batches:
            n, spans, found = [], [], []
            for text in b.column(0):
                raw = text.as_py() or b""
                words = words_of(raw)
                hit, own = index.hits(words)
                n.append(len(words))
                spans.append(places(raw, hit))
                found.append(sorted(own))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64()), pa.array(spans, pair), pa.array(found, pa.list_(pa.int64()))], [*b.schema.names[1:], "n_words", "spans", "items"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return docs.mapInArrow(run, f"{kept}, n_words long, spans {SPANS}, items array<long>"), shared


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, carry: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row ``(doc_id, n_words, spans, items)`` for each row of ``docs``; ``carry`` adds the whole row as a struct ``row``.

    spans: merged [start, end) word ranges, and their [first, last) code points, that lie in occurrences of item windows of ``width`` words
    (a shorter item is one window); items: ids of the items that own them, sorted. Null and wordless texts have
    no hits; items without words, or with a null id, have no windows; other columns are ignored; empty
    tables and repeated rows are no special case. The items are broadcast in slices whose texts have about ``slice_bytes`` bytes
    (a longer item is a slice of its own), one after another, each slice's hits written before the next: their number follows the benchmark, and each reads the documents once more.
    """
    columns = [F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id")]
    narrow = docs.select(*columns, *([F.struct(*docs.columns).alias("row")] if carry else []))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= slice_bytes:
        return _scan(narrow, [tuple(r) for r in items.collect()], width)[0]
    slices = -(-total * 2 // slice_bytes)
    narrow = written(narrow.withColumn("uid", F.monotonically_increasing_id()))
    own = F.pmod(F.xxhash64("item"), F.lit(slices))
    hits = Growing(docs.sparkSession, f"uid long, n_words long, spans {SPANS}, items array<long>")
    for s in range(slices):
        one, shared = _scan(narrow.select("text", "uid"), [tuple(r) for r in items.where(own == s).collect()], width)
        hits.add(one.where(F.lit(s == 0) | (F.size("spans") > 0)))  # every row once, for its number of words
        shared.destroy()
    found = hits.table()
    found = found.groupBy("uid").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.withColumn("spans", merged("spans", [("start", "end"), ("first", "last")]))
    return narrow.drop("text").join(found, "uid").drop("uid")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs``, with hit spans cut out of their texts; rows hit in over ``drop_share`` of their words go."""
    found = contamination(docs, benchmark, text_col=text_col, carry=True, **options)
    hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    left = found.where(hit <= F.lit(drop_share) * F.col("n_words"))
    text = replaced(F.col("row").getField(text_col), "spans", "first", "last", "")
    return left.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
