"""Quality rules: a document's own counts, then how many documents of a host share its lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import checkpointed, written

SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
#: A line is hashed in lower case, with its words a blank apart.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    m = len(number)
    pairs = ids[:-1] * m + ids[1:]
    if m > 1 << 20:  # three ids don't fit in a long
        pairs = np.unique(pairs, return_inverse=True)[1]
    window = pairs[:-1] * m + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    often = np.zeros(n - 2, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : n - 2 + k] |= often
    return int(hit.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int, list[bytes], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then the distinct folded lines and their words."""
    words = text.split()
    seen: set[bytes] = set()
    dup, folded = 0, {}
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
            key = b" ".join(own).translate(FOLD)
            folded[key] = folded.get(key, 0) + len(own)
    chars = len(b"".join(words).translate(None, CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, dup, repeated_words(words), list(folded), list(folded.values())


def line_hash(folded: bytes) -> int:
    """Hash of a line in lower case with its words a blank apart, as a signed long."""
    import xxhash

    h = xxhash.xxh64_intdigest(folded)
    return h - (1 << 64) if h >> 63 else h


def counted(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: bool = False) -> DataFrame:
    """The base counts and line hashes of each row, under a new key ``uid``; ``carry`` adds the whole row as a struct ``row``."""
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = b.column(3).field(place) if carry else b.column(3)
            texts = [t.as_py() or b"" for t in texts.cast(pa.binary())]
            rows = [base_counts(t) for t in texts]
            whole = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
            hashes = [[line_hash(x) for x in r[5]] for r in rows]
            arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            more = [b.column(3)] if carry else []
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *arrays, pa.array(whole), pa.array(hashes, pa.list_(pa.int64())), pa.array([r[6] for r in rows], pa.list_(pa.int32())), *more], ["uid", "doc_id", "host", *fields, "whole", "lines", "line_words", *(["row"] if carry else [])])

    text = F.col(text_col).cast("string")
    last = F.struct(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns]).alias("row") if carry else text.alias("text")
    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), last)
    kind = f", row {narrow.schema['row'].dataType.simpleString()}" if carry else ""
    return narrow.mapInArrow(run, "uid long, doc_id long, host string, " + ", ".join(f"{f} long" for f in fields) + ", whole long, lines array<long>, line_words array<int>" + kind)


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: bool, min_words: int, max_repeat: float, line_docs: int, line_share: float, max_removed: float) -> DataFrame:
    """``counted`` without lines, with ``removed`` (line hashes), ``n_removed_words``, ``base_failed`` and ``kept``."""
    docs = written(counted(docs, id_col, text_col, host_col, carry))
    sizes = docs.select("host", "whole").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = docs.select("uid", "doc_id", "host", "whole", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lines = lines.select("uid", "doc_id", "host", "whole", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    holders = lines.groupBy("host", "line", "whole").agg(F.min("doc_id").alias("first"))
    often = holders.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).where(F.col("n") > line_docs)
    often = checkpointed(often.join(sizes, "host").where(F.col("n") > F.lit(line_share) * F.col("host_docs")).select("host", "line", "first"))
    removed = lines.join(often, ["host", "line"]).where("doc_id is null or first is null or doc_id <> first")
    removed = removed.groupBy("uid").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed"))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))
    out = docs.drop("lines", "line_words", "host", "whole").join(removed, "uid", "left").withColumn("base_failed", base)
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= F.lit(max_removed) * F.col("n_words")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat: float = 0.5, line_docs: int = 20, line_share: float = 0.05, max_removed: float = 0.7) -> DataFrame:
    """One row a document: base counts, ``base_failed``, ``n_removed_words`` and ``kept``.

    Lines are folded and hashed. For each host, the distinct documents that hold a line are counted (copies
    of one text once). A line in more than ``line_docs`` documents and in more than ``line_share`` of the host's
    distinct documents is removed everywhere but in the document with the host's least ``doc_id`` that has it. A document that fails a
    base rule, or loses more than ``max_removed`` of its words, is not kept. Null and wordless texts have zero
    counts and fail; null hosts are one host; repeated rows are judged alike; rows with a null doc_id are never a line's first
    place; other columns are ignored; empty in, empty out.
    """
    out = _judged(docs, id_col, text_col, host_col, False, min_words, max_repeat, line_docs, line_share, max_removed)
    return out.drop("removed", "uid").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat: float = 0.5, line_docs: int = 20, line_share: float = 0.05, max_removed: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with the removed lines cut out of their texts; the columns of ``docs``.

    Lines are cut whole, with their line ends; all others stay as they are. The odd cases are those of ``quality``.
    """
    out = _judged(docs, id_col, text_col, host_col, True, min_words, max_repeat, line_docs, line_share, max_removed).where("kept")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = b.column(0), []
            for text, gone in zip(rows.field(place).cast(pa.binary()), b.column(1)):
                text, gone = text.as_py(), set(gone.as_py() or ())
                if gone:
                    text = b"\n".join(x for x in text.split(b"\n") if not x.strip() or line_hash(b" ".join(x.split()).translate(FOLD)) not in gone)
                texts.append(text)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else rows.field(i) for i in range(rows.type.num_fields)], [f.name for f in rows.type])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema["row"].dataType.fields)
    return out.select("row", "removed").mapInArrow(run, kinds)
