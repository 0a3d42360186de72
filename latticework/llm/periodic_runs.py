"""Periodic runs of words inside one text, found as the words arrive: dyadic square catching.

Over the words read so far, every completed block of ``2**j`` words that starts at a multiple of its length is a catcher. It has a
name: equal blocks of one length have equal names, as a name stands for the pair of its halves' names. When a word is
appended, the suffixes of 1, 2, 4, ... words are named in the same way; a suffix whose name a catcher at a suitable distance has
is an occurrence of that block one period later, as any square of period p in [2s - 1, 4s - 2] has an aligned block of s words in its
first half. The equality at that distance is then stretched backwards once and forwards by each word that is appended: it is a square
once it holds for p words, and all squares of one stretch merge into one run, reported when a word breaks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Catchers:
    """The runs of a growing sequence of words; ``append`` each word, then ``finish``.

    ``least_periods`` (at least 2) and ``least_words`` are what a run must have to be kept. A run is kept once, with its smallest period.
    """

    def __init__(self, least_periods: int = 4, least_words: int = 6):
        self.periods, self.words = max(2, least_periods), least_words
        self.codes: dict[object, int] = {}
        self.seq: list[int] = []
        self.pairs: list[dict[tuple[int, int], int]] = [{}]  # level -> names of its completed blocks, by their halves
        self.blocks: list[list[int]] = [[]]  # level -> names of its completed blocks, in order
        self.suffix: list[dict[int, tuple[int, int]]] = [{}]  # level -> the latest suffixes that some block equals, by last word modulo size + 1: last word, name
        self.open: dict[int, int] = {}  # period -> first word that equals the one a period before it
        self.runs: list[tuple[int, int, int]] = []

    def append(self, word: object) -> None:
        seq, code = self.seq, self.codes.setdefault(word, len(self.codes))
        i = len(seq)
        seq.append(code)
        if self.open:
            for p in [p for p in self.open if seq[i - p] != code]:
                self._close(p, i)
        if i:
            if seq[i - 1] == code and 1 not in self.open:
                self._catch(1, i, 1)
            if i > 1 and seq[i - 2] == code and 2 not in self.open:
                self._catch(2, i, 1)
            self._suffixes(i)
        self._complete(i)

    def finish(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of all runs, by start and period."""
        for p in list(self.open):
            self._close(p, len(self.seq))
        return sorted(self.runs)

    def _suffixes(self, i: int) -> None:
        """Name the suffixes of 2, 4, ... words as long as some completed block equals them, and let the blocks in reach catch."""
        left, right, size, level = self.seq[i - 1], self.seq[i], 2, 1
        while level < len(self.pairs):
            name = self.pairs[level].get((left, right))
            if name is None:
                return  # no completed block of this size, so none of a larger one either: its right half would be one
            self.suffix[level][i % (size + 1)] = i, name
            blocks = self.blocks[level]
            first = i - size + 1  # of the suffix
            for b in range(max(0, -((4 * size - 2 - first) // size)), min(len(blocks) - 1, (first - 2 * size + 1) // size) + 1):
                if blocks[b] == name:
                    p = first - b * size
                    if p not in self.open:
                        self._catch(p, i, size)
            last, left = self.suffix[level].get((i - size) % (size + 1), (-1, -1))
            if last != i - size:
                return
            right = name
            size, level = 2 * size, level + 1

    def _catch(self, p: int, i: int, size: int) -> None:
        """Follow period ``p``, whose last ``size`` words up to ``i`` repeat those a period before."""
        at = i - size
        for q, since in self.open.items():
            if q < p and p % q == 0 and since - q <= at + 1 - p:
                return  # inside a run of a period that divides it: the same run
        seq = self.seq
        while at >= p and seq[at] == seq[at - p]:
            at -= 1
        self.open[p] = at + 1

    def _close(self, p: int, end: int) -> None:
        start = self.open.pop(p) - p
        if end - start >= max(self.words, self.periods * p):
            self.runs.append((start, end - start, p))

    def _complete(self, i: int) -> None:
        """Name the blocks that word ``i`` completes, smallest first."""
        level, size = 1, 2
        while (i + 1) % size == 0:
            if level == len(self.pairs):
                self.pairs.append({})
                self.blocks.append([])
                self.suffix.append({})
            halves = (self.seq[i - 1], self.seq[i]) if level == 1 else tuple(self.blocks[level - 1][-2:])
            names = self.pairs[level]
            self.blocks[level].append(names.setdefault(halves, len(names)))
            level, size = level + 1, 2 * size


def found(words: list, least_periods: int = 4, least_words: int = 6) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of ``words``, by start and period."""
    catchers = Catchers(least_periods, least_words)
    for w in words:
        catchers.append(w)
    return catchers.finish()


def kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that a run has after its first period."""
    if not runs:
        return words
    cut, out, at = sorted((s + p, s + n) for s, n, p in runs), [], 0
    for begin, end in cut:
        if end > at:
            out += words[at : max(at, begin)]
            at = end if begin <= at else max(at, end)
    return out + words[at:]


def periodic_runs(docs: DataFrame, text_col: str = "text", least_periods: int = 4, least_words: int = 6, runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """``docs`` with its runs of words and its text without their repeats, in columns ``runs_col`` and ``collapsed_col``.

    Words are the stretches of ``[^\\x20\\x09-\\x0D]``, numbered from 0. A run is a longest stretch with smallest period p of at least
    ``least_periods`` periods and ``least_words`` words; they may overlap. The collapsed text has the words that no run holds after its first period, joined by one space.
    A null, empty or blank text has no words, no runs and an empty collapsed text; repeated rows give repeated rows; an
    empty table gives an empty result. Columns of the two new names must not be in ``docs`` already (ValueError).
    No shuffle: a text is handled where it lies, in time of its words times the logarithm of its longest run and in memory of its words.
    """
    if clash := {runs_col, collapsed_col} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = f"{runs_col} {RUNS}, {collapsed_col} string"
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            all_runs, texts = [], []
            for text in batch.column(place).cast(pa.binary()).to_pylist():
                words = (text or b"").split()  # bytes split at just those six characters
                runs = found(words, least_periods, least_words)
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(kept(words, runs)))
            collapsed = pa.array(texts, pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(all_runs, kind), collapsed], names=[*batch.schema.names, runs_col, collapsed_col])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, *StructType.fromDDL(schema).fields]))


def longest(runs: Column) -> Column:
    """The run of ``runs`` with the greatest length in periods, exactly compared; the first of equal ones; null where there is none."""
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.element_at(runs, 1), better))
