"""Packing token sequences by the linear grouping scheme, then best fit for what is small."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import written

#: A-Z in lower case; blanks for tabs and line ends.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\n\r\t" else c for c in range(256))
#: Punctuation that may follow a word.
CLOSING = ".,;:!?%$*&#|"
#: Distinct words that a tokenizing task remembers before it starts anew.
REMEMBERED = 300_000


class WordEncoder:
    """Token ids of whole texts, white-space-free chunk by chunk.

    The tokenizer lower-cases, drops white space before it looks at anything else, and parts letters from
    punctuation; so a text's ids are those of its chunks in order, and a chunk of letters and closing
    punctuation has the ids of the two. Only what wasn't seen before is given to the tokenizer: words of a to z to its model, other words of letters joined to one
    string; ids are parted at the tokens that end a word.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def alone(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.parts[w] = np.array(e.ids, dtype="<u4").tobytes()

    def cut(self, words: list[str], ids: list[int]) -> None:
        """Parts the ids of joined words at the tokens that end a word."""
        raw = np.array(ids, dtype="<u4")
        at = [0, *(4 * (np.flatnonzero(self.ends_word[raw]) + 1)).tolist()] if len(raw) else [0]
        if len(at) == len(words) + 1:
            self.parts.update(zip(words, map(raw.tobytes().__getitem__, map(slice, at, at[1:]))))
        else:  # a letter that the tokenizer takes for something else
            self.alone(words)

    def learn(self, chunks: list[str]) -> None:
        parts, known = self.parts, self.known
        words, others = [w for w in chunks if w.isalpha()], [w for w in chunks if not w.isalpha()]
        halves = [w.rstrip(CLOSING) for w in others]
        closed, odd = [w for w, c in zip(others, halves) if c.isalpha()], [w for w, c in zip(others, halves) if not c.isalpha()]
        cores = [c for c in halves if c.isalpha()]
        tails = [w[len(c) :] for w, c in zip(closed, cores)]
        new = list(set(words).union(cores).difference(parts))
        plain, foreign = [w for w in new if w.isascii()], [w for w in new if not w.isascii()]
        tokens = self.tokenizer.model.tokenize  # words of a to z are left as they are by all that comes before the model
        self.cut(plain, [t.id for w in plain for t in tokens(w)])
        if foreign:
            self.cut(foreign, self.tokenizer.encode_batch_fast([" ".join(foreign)], add_special_tokens=False)[0].ids)
        self.alone(list(set(tails).union(odd).difference(parts)))
        of = parts.__getitem__
        known.update(zip(words, map(of, words)))
        known.update(zip(odd, map(of, odd)))
        known.update(zip(closed, map(add, map(of, cores), map(of, tails))))

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Of each text the little-endian unsigned 32-bit ids, the end id last."""
        split = [(t or b"").translate(FOLD).decode().split(" ") for t in texts]
        every = set().union(*split)
        new = list(every.difference(self.known))
        if new:
            if len(self.known) + len(new) > REMEMBERED or len(self.parts) + len(new) > 2 * REMEMBERED:
                new = list(every)
                self.known.clear()
            if len(self.parts) + len(new) > 2 * REMEMBERED:
                self.parts.clear()
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) + self.end for words in split]


def encoder_of_worker(path: str, end_id: int) -> WordEncoder:
    """The encoder that this Python process keeps for its later tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders"))
    if (path, end_id) not in vars(kept):
        vars(kept)[path, end_id] = WordEncoder(path, end_id)
    return vars(kept)[path, end_id]


def _some(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[list[bytes | None]]:
    """Runs of texts of about ``size`` bytes."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or b"")
        if held >= size:
            yield part
            part, held = [], 0
    yield part


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """``(uid, doc_id, n_tokens, crcs)`` for each row; crcs has the CRC-32 of each piece of ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of_worker(tokenizer, end_id)
        for b in batches:
            n, crcs = [], []
            for part in _some(b.column(2).to_pylist()):
                for ids in encoder.ids(part):
                    n.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["uid", "doc_id", "n_tokens", "crcs"])

    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "uid long, doc_id long, n_tokens long, crcs array<long>")


def grouped_sizes(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """(rounded length, number) of groups of near-equal number, from the longest on."""
    order = np.argsort(-lengths)
    lengths, counts = lengths[order], counts[order]
    part = np.minimum((np.cumsum(counts) - counts) * groups // max(1, counts.sum()), groups - 1)
    return [(int(lengths[part == p].max()), int(counts[part == p].sum())) for p in np.unique(part)]


def _best_pattern(sizes: np.ndarray, gain: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within ``capacity`` with the largest gain (knapsack by length)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -1
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            value = best[c - sizes[fits]] + gain[fits]
            k = value.argmax()
            if value[k] > best[c] + 1e-12:
                best[c], took[c] = value[k], fits[k]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return best[capacity], pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 200) -> list[tuple[tuple[int, ...], float]]:
    """Patterns and how often each is used in a fractional optimum, by column generation.

    A basis of one pattern a size is kept; a pattern that the prices favour replaces the column which
    the ratio test picks.
    """
    s, d = np.array(sizes), np.array(demand, dtype=float)
    if not len(s):
        return []
    basis = np.diag((capacity // s).astype(float))
    use = np.linalg.solve(basis, d)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(s)))
        value, pattern = _best_pattern(s, price, capacity)
        if value <= 1 + 1e-9:
            break
        way = np.linalg.solve(basis, pattern)
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, ratio.argmin()] = pattern
        use = np.maximum(np.linalg.solve(basis, d), 0)
    return [(tuple(int(x) for x in basis[:, i]), float(use[i])) for i in range(len(s)) if use[i] > 0]


class Bins:
    """Open sequences by free space; the fullest one that still fits is found with a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.mask = capacity, 0, 0
        self.by_free: dict[int, list[int]] = {}
        self.used: list[int] = []

    def open(self) -> int:
        self.used.append(0)
        self.count += 1
        return self.count - 1

    def shelve(self, b: int) -> None:
        if free := self.capacity - self.used[b]:
            self.by_free.setdefault(free, []).append(b)
            self.mask |= 1 << free

    def fit(self, length: int) -> int:
        above = self.mask >> length
        if not above:
            return self.open()
        free = length + (above & -above).bit_length() - 1
        held = self.by_free[free]
        b = held.pop()
        if not held:
            self.mask &= ~(1 << free)
        return b

    def put(self, b: int, length: int) -> int:
        self.used[b] += length
        return self.used[b] - length


def packed(lengths: np.ndarray, bounds: list[int], plan: list[tuple[tuple[int, ...], float]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length: planned configurations first, then best fit, longest first.

    ``bounds`` has the rounded size of each group, longest first; ``plan`` the configurations with
    the share of the whole that this block should make of each. Places of the plan for which the block has no
    document stay free; documents that the plan leaves over are fitted like small ones.
    """
    order = np.argsort(-lengths, kind="stable")
    least = bounds[1:] + [0]
    stock: list[list[int]] = [[] for _ in bounds]
    rest, group = [], 0
    floor = min((b for b in bounds), default=0)
    for i in order.tolist():
        n = int(lengths[i])
        while group < len(bounds) and n <= least[group]:
            group += 1
        (stock[group] if group < len(bounds) and n <= bounds[group] else rest).append(i)
    bins, seq, off = Bins(capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    del floor
    for pattern, share in sorted(plan, key=lambda x: -x[1]):
        for _ in range(int(share)):
            if not all(len(stock[g]) >= k for g, k in enumerate(pattern)):
                break
            b = bins.open()
            for g, k in enumerate(pattern):
                for _ in range(k):
                    i = stock[g].pop()
                    seq[i], off[i] = b, bins.put(b, int(lengths[i]))
            bins.shelve(b)
    left = sorted([i for g in stock for i in g] + rest, key=lambda i: -int(lengths[i]))
    for i in left:
        b = bins.fit(int(lengths[i]))
        seq[i], off[i] = b, bins.put(b, int(lengths[i]))
        bins.shelve(b)
    return seq, off


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, groups: int = 24, large: float = 0.25, block_docs: int = 8192) -> DataFrame:
    """One row ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece.

    A document's ids (null text: none) and ``end_id`` are cut into pieces of ``capacity`` ids. Full pieces
    are sequences of their own. Of the others' lengths, at most ``capacity`` distinct ones, a histogram is made; lengths
    over ``large * capacity`` are rounded up in ``groups`` groups of equal number, for which
    the driver finds the best configurations. Blocks of about ``block_docs`` documents, drawn by a hash,
    then fill those with their own documents and best-fit the rest; a block leaves about one sequence partly free. Repeated
    rows and null ids are packed like any other; other columns are ignored; empty in, empty out.
    """
    docs = written(tokenized(docs, tokenizer, capacity, id_col, text_col, end_id))
    tail = (F.col("n_tokens") % capacity).cast("int")
    rows = docs.groupBy(tail.alias("tail")).count().collect()  # at most one for each length
    blocks = max(1, -(-sum(r["count"] for r in rows) // block_docs))
    big = [(r["tail"], r["count"]) for r in rows if r["tail"] > large * capacity]
    sizes = grouped_sizes(np.array([x for x, _ in big]), np.array([n for _, n in big]), groups) if big else []
    bounds = [s for s, _ in sizes]
    plan = [(p, n / blocks) for p, n in configurations(bounds, [n for _, n in sizes], capacity)]

    def block(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("uid")
        n = own["n_tokens"].to_numpy()
        ends = n % capacity
        part = np.flatnonzero(ends)
        seq, off = packed(ends[part], bounds, plan, capacity)
        crcs = own["crcs"].to_list()
        each = np.array([len(c) for c in crcs])
        row = np.repeat(np.arange(len(n)), each)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        length = np.minimum(n[row] - piece * capacity, capacity)
        place, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        short = length < capacity
        place[short], offset[short] = seq, off
        place[~short] = np.arange((~short).sum()) + (seq.max() + 1 if len(seq) else 0)
        ids = own["doc_id"].take(row).astype("Int64").array
        return pd.DataFrame({"doc_id": ids, "piece": piece.astype("int32"), "start": piece * capacity, "length": length, "ids_crc32": np.concatenate(crcs).astype(np.int64), "sequence_id": (int(own["block"].iloc[0]) << 32) + place, "offset": offset})

    drawn = docs.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    return drawn.groupBy("block").applyInPandas(block, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
