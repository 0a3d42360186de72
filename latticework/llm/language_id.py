"""Language identification: word log frequencies first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, token, n)`` of the words of ``docs(lang, text)``, counted by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "token", "n"])
            counts.clear()
            return out

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for w, n in Counter(WORD.findall(text.as_py().lower())).items():
                    counts[lang, w] += n
                if len(counts) > 200_000:
                    yield flushed()
        yield flushed()

    return docs.mapInArrow(run, "lang string, token string, n long").groupBy("lang", "token").agg(F.sum("n").alias("n"))


def hashes(tokens: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in tokens), np.uint64, len(tokens))


class Table:
    """Log frequencies of tokens by language: sorted hashes and a row for each; 8 bytes and 4 a language for a token."""

    def __init__(self, langs: list[str], lang: list[str], token: list[str], n: list[int]):
        number = {x: i for i, x in enumerate(langs)}
        self.keys, at = np.unique(hashes(token), return_inverse=True)
        counts = np.zeros((len(self.keys), len(langs)))
        np.add.at(counts, (at, np.array([number[x] for x in lang], np.int64)), n)
        self.rows = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))).astype(np.float32) if len(counts) else counts.astype(np.float32)

    def find(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens are known, and the row numbers of those."""
        if not len(self.keys) or not tokens:
            return np.zeros(len(tokens), bool), np.empty(0, np.int64)
        h = hashes(tokens)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        return known, at[known]


class Backoff:
    """Log frequencies of words, and of n-grams by their length, for each language."""

    def __init__(self, docs: dict[str, int], words: tuple[list, list, list], grams: tuple[list, list, list]):
        """``docs`` has the documents a language; ``words`` and ``grams`` the languages, tokens and numbers of the counts."""
        self.langs = sorted(docs)
        total = sum(docs.values()) or 1
        self.prior = np.array([math.log(docs[x] / total) for x in self.langs])
        self.words = Table(self.langs, *words)
        by_length: dict[int, tuple[list, list, list]] = {n: ([], [], []) for n in ORDERS}
        for row in zip(*grams):
            for column, value in zip(by_length[len(row[1])], row):
                column.append(value)
        self.grams = {n: Table(self.langs, *by_length[n]) for n in ORDERS}

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word: its own, or for unseen ones the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        known, at = self.words.find(words)
        out[known] = self.words.rows[at]
        left = np.flatnonzero(~known).tolist()
        for n in ORDERS:
            owner, pieces = [], []
            for i in left:
                marked = f"_{words[i]}_"
                own = [marked[x : x + n] for x in range(len(marked) - n + 1)]
                owner += [i] * len(own)
                pieces += own
            known, at = self.grams[n].find(pieces)
            own = np.array(owner, np.int64)[known]
            np.add.at(out, own, self.grams[n].rows[at])
            held = np.bincount(own, minlength=len(words))
            out[held > 0] /= held[held > 0, None]
            left = [i for i in left if not held[i]]
            if not left:
                break
        return out


class Scorer:
    """Scores texts; remembers the rows of words up to a number, then starts anew."""

    def __init__(self, model: Backoff, remembered: int = 50_000):
        self.model, self.limit = model, remembered
        self.number: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)))

    def places(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words of a text, all of them in ``rows``."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new and len(self.number) + len(new) > self.limit:
            self.number.clear()
            new = list(dict.fromkeys(words))
        if new:
            first = len(self.number)
            if first + len(new) > len(self.rows):
                more = np.empty((2 * (first + len(new)), len(self.model.langs)))
                more[:first] = self.rows[:first]
                self.rows = more
            self.rows[first : first + len(new)] = self.model.rows(new)
            self.number.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def score(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall((text or "").lower())
        if not self.model.langs or not any(any(map(str.isalpha, w)) for w in words):  # a run of digits such as superscripts has no letter
            return "und", 0.0
        at = self.places(words)
        s = self.model.prior + self.rows[at].sum(axis=0)
        best = int(s.argmax())
        return self.model.langs[best], float(1 / np.exp(s - s[best]).sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 2000) -> Backoff:
    """Learn from rows with text and lang that are not held out: about ``sample_docs`` of each language, by a hash of id and text.

    All words and n-grams of that sample make the model; the sample's bound is the model's. Equal rows are drawn all or none.
    """
    spark = docs.sparkSession
    draw = F.pmod(F.xxhash64(F.lit("lid"), F.col(id_col), F.col(text_col).cast("string")), F.lit(1 << 62))
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), draw.alias("draw"))
    total = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    share = spark.createDataFrame([(k, int((1 << 62) * min(1.0, sample_docs / n))) for k, n in total.items()] or [("", 0)], "lang string, below long")
    sample = known.join(F.broadcast(share), "lang").where("draw < below").select("lang", "text")
    words = word_counts(sample).persist()
    gathered = lambda df: tuple(c.to_pylist() for c in df.select("lang", "token", "n").toArrow().columns)
    marked = F.concat(F.lit("_"), "token", F.lit("_"))
    of = lambda n: lambda i: F.substring(marked, i, F.lit(n))
    pieces = F.flatten(F.array(*[F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), of(n))).otherwise(F.array().cast("array<string>")) for n in ORDERS]))
    grams = words.select("lang", F.explode(pieces).alias("token"), "n").groupBy("lang", "token").agg(F.sum("n").alias("n"))
    model = Backoff(total, gathered(words), gathered(grams))
    words.unpersist()
    return model


def identify(docs: DataFrame, model: Backoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, held_out, lang_pred, score)`` for each row of ``docs``.

    The prediction is ``und``, with score 0, for a null text and one without a letter, or when nothing was
    learned; else the language with the largest summed log frequency, ties to the first in order, and its
    share of the posterior. Whole texts are read; repeated rows, null ids and other columns make no
    difference; empty in, empty out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # what a bounded sample holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Backoff.__new__(Backoff)
        vars(own).update(shared.value)
        scorer = Scorer(own)
        for b in batches:
            got = [scorer.score(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
