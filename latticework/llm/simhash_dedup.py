"""SimHash near-duplicates: a Gray-ordered hierarchical index within pigeonhole buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import checkpointed, written
from latticework.functions.hubs import listed
from latticework.operators.components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Children of an index node, and pairs of nodes that are compared in one numpy call.
FANOUT, CHUNK = 8, 1 << 19


def signature(text: bytes | None, k: int, words: int = 1) -> np.ndarray:
    """SimHash of the ``k``-word shingles of ``text``, repeats included, as ``words`` 64-bit words.

    The first word is the majority of the shingles' XXH64 bits, further ones that of remixed hashes.
    """
    import xxhash

    own = (text or b"").translate(LOWER).split()
    if not own:
        return np.zeros(words, np.uint64)
    shingles = map(b" ".join, zip(*(own[i:] for i in range(k)))) if len(own) >= k else [b" ".join(own)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros((words, 64), dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        for w in range(words):
            if w:
                part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                part ^= part >> np.uint64(32)
            ones[w] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: bytes | None, k: int) -> int:
    """64-bit SimHash of the ``k``-word shingles of ``text``."""
    return int(signature(text, k)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row for each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _merge(lab: np.ndarray, i: np.ndarray, j: np.ndarray, took: list | None = None) -> np.ndarray:
    """Labels after the pairs (i, j) were joined; a label is the least place of its component.

    To ``took`` goes a pair for each component that was joined to another: together a spanning forest.
    """
    while True:
        a, b = lab[i], lab[j]
        if (open_ := a != b).any():
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(lab, high, low)
            if took is not None:
                done = np.flatnonzero(lab[high] == low)
                one = done[np.unique(high[done], return_index=True)[1]]
                took.append((i[one], j[one]))
            while (nxt := lab[lab]).tobytes() != lab.tobytes():
                lab = nxt
        else:
            return lab


def _children(pairs: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the given pairs of nodes; each unordered pair once."""
    a, b = pairs
    ca, cb = start[a + 1] - start[a], start[b + 1] - start[b]
    n = ca * cb
    rep = np.repeat(np.arange(len(a)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = start[a][rep] + off // cb[rep], start[b][rep] + off % cb[rep]
    keep = i <= j
    return i[keep], j[keep]


def gray_links(bucket: np.ndarray, fp: np.ndarray, radii: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints that are joined, within their bucket, by steps of up to ``radii[-1]`` bits.

    ``bucket`` numbers the rows' buckets; ``fp`` has one or more 64-bit words a row. Rows are sorted by Gray rank in each bucket, and consecutive
    ones form nodes that hold the bits on which they agree. A pair of nodes is left when those bits
    already differ in more than ``radius`` places, joined whole when all free bits can't exceed it, and
    left when both lie in one component already. The smaller of several ``radii`` are worked off first, so that the links
    are about those of a least spanning forest. Returns pairs of rows that differ in no more bits than the radius they were joined at.
    """
    fp = fp.reshape(len(bucket), -1)
    most = max(1, 2 * CHUNK // FANOUT**2 // fp.shape[1])  # pairs of nodes at a time, fewer of long rows
    order = np.lexsort((gray_rank(fp[:, 0]), bucket))
    f, g = fp[order], bucket[order]
    n, lab = len(f), np.arange(len(f))
    levels = [(np.arange(n + 1), f, f, np.arange(n + 1), g)]  # child starts, and-bits, or-bits, row starts, bucket
    while True:
        start, low, high, rows, own = levels[-1]
        m = len(own)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if m else np.array([], int)
        if len(first) == m:
            break
        within = np.arange(m) - np.repeat(first, np.diff(np.r_[first, m]))
        cut = np.flatnonzero(within % FANOUT == 0)
        levels.append((np.r_[cut, m], np.bitwise_and.reduceat(low, cut, axis=0), np.bitwise_or.reduceat(high, cut, axis=0), np.r_[rows[cut], n], own[cut]))
    took: list[tuple[np.ndarray, np.ndarray]] = []
    for least, radius in zip([0, *radii], radii):
        lab = _joined(levels, lab, least, radius, most, took)
    if not took:
        return np.array([], int), np.array([], int)
    return tuple(order[np.concatenate(side)] for side in zip(*took))


def _joined(levels: list[tuple], lab: np.ndarray, least: int, radius: int, most: int, took: list) -> np.ndarray:
    """Labels after all pairs of rows within ``radius`` below the top nodes were joined; of those that are looked at together the nearest first, in steps from ``least`` on."""
    top = np.arange(len(levels[-1][4]))
    stack = [(len(levels) - 1, top[at : at + most], top[at : at + most]) for at in range(0, len(top), most)]
    while stack:
        level, a, b = stack.pop()
        _, low, high, rows, _ = levels[level]
        fixed = ~(low ^ high)
        known = fixed[a] & fixed[b]
        apart = np.bitwise_count((low[a] ^ low[b]) & known).sum(axis=1, dtype=np.int64)
        near = apart <= radius
        a, b, known, apart = a[near], b[near], known[near], apart[near]
        if level == 0:
            for near in range(least, radius + 1, max(1, -(-(radius - least) // 4))) if least else (radius,):
                lab = _merge(lab, a[apart <= near], b[apart <= near], took)
            lab = _merge(lab, a, b, took)
            continue
        one = np.minimum.reduceat(lab, rows[:-1]), np.maximum.reduceat(lab, rows[:-1])
        open_ = ~((one[0][a] == one[1][a]) & (one[0][b] == one[1][b]) & (one[0][a] == one[0][b]))
        a, b, known, apart = a[open_], b[open_], known[open_], apart[open_]
        whole = apart + np.bitwise_count(~known).sum(axis=1, dtype=np.int64) <= radius
        for node in (a[whole], b[whole]):  # every row of both nodes is near every other
            held = rows[node + 1] - rows[node]
            each = np.repeat(rows[node] - np.cumsum(held) + held, held) + np.arange(held.sum())
            lab = _merge(lab, np.repeat(rows[a[whole]], held), each, took)
        a, b = a[~whole], b[~whole]
        start = levels[level][0]
        far = np.argsort(-(b - a), kind="stable")  # close pairs come off the stack first
        a, b = a[far], b[far]
        for at in range(0, len(a), most):
            pair = _children((a[at : at + most], b[at : at + most]), start)
            if level == 1:  # rows with themselves say nothing
                other = pair[0] != pair[1]
                pair = pair[0][other], pair[1][other]
            if len(pair[0]):
                stack.append((level - 1, *pair))
    return lab


def _bucket_links(radii: list[int], rows_held: int):
    """Reads ``(k1, k2, id, sig)`` sorted by bucket (k1, k2); works on whole buckets, about ``rows_held`` rows at a time.

    Gives the links ``(src, dst, bits)`` with the number of bits in which the two differ.
    """

    def work(keys: np.ndarray, ids: np.ndarray, sigs: list[bytes]) -> pa.RecordBatch:
        number = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.array([], int)
        i = j = bits = np.array([], int)
        if len(keys):
            fp = np.frombuffer(b"".join(sigs), dtype="<u8").reshape(len(keys), -1)
            i, j = gray_links(number, fp, radii)
            bits = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(bits, pa.int32())], ["src", "dst", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sigs = np.empty((0, 2), np.int64), np.empty(0, np.int64), []
        for b in batches:
            table = pa.Table.from_batches([b])
            keys = np.concatenate([keys, np.stack([table["k1"].to_numpy(), table["k2"].to_numpy()], 1)])
            ids = np.concatenate([ids, table["id"].to_numpy()])
            sigs += table["sig"].to_pylist()
            if len(ids) >= rows_held:
                last = np.flatnonzero((keys != keys[-1]).any(axis=1))
                if len(last):
                    cut = last[-1] + 1
                    yield work(keys[:cut], ids[:cut], sigs[:cut])
                    keys, ids, sigs = keys[cut:], ids[cut:], sigs[cut:]
        yield work(keys, ids, sigs)

    return run


def _pieces(fp, widths: list[int], offset: int = 0):
    """The bit fields of ``fp`` with these widths, from the lowest bit on."""
    out = []
    for w in widths:
        out.append(F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << w) - 1)))
        offset += w
    return out


def linked_fingerprints(fps: DataFrame, radius: int = 3, bucket_rows: int = 50_000, rows_held: int = 400_000) -> DataFrame:
    """``(node, component)`` of the distinct fingerprints ``fps(fp)`` that have a partner within ``radius`` bits.

    Two such fingerprints agree on at least one of ``radius + 1`` bit fields, so each goes to one bucket
    a field. Buckets of more than ``bucket_rows`` rows are split in the same way on the other bits
    (their number is bounded by the field width, so their list may be broadcast). Each bucket
    gives a spanning forest, never all pairs.
    """
    fields = radius + 1
    widths = [64 // fields + (i < 64 % fields) for i in range(fields)]
    fp = F.col("fp")
    keyed = fps.select("fp", F.posexplode(F.array(*_pieces(fp, widths))).alias("field", "value"))
    hot = keyed.groupBy("field", "value").count().where(F.col("count") > bucket_rows).select("field", "value", F.lit(True).alias("hot"))
    keyed = keyed.join(F.broadcast(checkpointed(hot)), ["field", "value"], "left")
    k1 = F.col("field") * (1 << 32) + F.col("value")
    plain = keyed.where("hot is null").select("fp", k1.alias("k1"), F.lit(-1).cast("long").alias("k2"))
    parts = []
    for i, w in enumerate(widths):  # the other bits, gathered below one another
        low = sum(widths[:i])
        rest = F.shiftrightunsigned(fp, low + w) if low + w < 64 else F.lit(0).cast("long")
        rest = F.shiftleft(rest, low).bitwiseOR(fp.bitwiseAND(F.lit((1 << low) - 1))) if low else rest
        sub = [(64 - w) // fields + (x < (64 - w) % fields) for x in range(fields)]
        one = keyed.where(F.col("hot") & (F.col("field") == i)).select("fp", k1.alias("k1"), F.posexplode(F.array(*_pieces(rest, sub))).alias("f2", "v2"))
        parts.append(one.select("fp", "k1", (F.col("f2") * (1 << 40) + F.col("v2")).alias("k2")))
    for p in parts:
        plain = plain.unionByName(p)
    plain = plain.select("k1", "k2", F.col("fp").alias("id"), F.unhex(F.expr("regexp_replace(lpad(hex(fp), 16, '0'), '(..)(..)(..)(..)(..)(..)(..)(..)', '$8$7$6$5$4$3$2$1')")).alias("sig"))
    links = plain.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_bucket_links([radius], rows_held), "src long, dst long, bits int")
    return connected_components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, radius: int = 3) -> DataFrame:
    """One row ``(doc_id, fp, component_id)`` for each row of ``docs``.

    component_id is the smallest doc_id that steps of up to ``radius`` differing fingerprint bits reach.
    A null or wordless text has fingerprint zero and is linked like any other; fewer than ``k`` words are
    one shingle; rows that repeat are linked to each other; a row with a null doc_id takes the least id
    of its group (null where none has one). Other columns of ``docs`` are ignored. Empty in, empty out.
    """
    docs = written(fingerprints(docs, id_col, text_col, k))
    groups = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    nodes = linked_fingerprints(groups.select("fp"), radius).withColumnRenamed("node", "fp")
    nodes = checkpointed(nodes.join(groups, "fp").select("fp", "component", "least"))
    roots = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = nodes.join(roots, "component").select("fp", "component_id")
    same = groups.where("n > 1").join(nodes.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    to = checkpointed(linked.unionByName(same))
    return docs.join(to, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """The distinct ``k``-word shingles of ``text`` as sorted hashes; fewer words are one shingle, none are none."""
    import xxhash

    own = (text or b"").translate(LOWER).split()
    shingles = set(map(b" ".join, zip(*(own[i:] for i in range(k))))) if len(own) >= k else {b" ".join(own)} if own else set()
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def _truly_similar(k: int, similarity: float):
    """Reads ``(src, dst, a, b)``, b being the texts; gives the links whose shingle sets have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = shingle_hashes(a.as_py(), k), shingle_hashes(b.as_py(), k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["src", "dst"])

    return run


def bands_of(sigs: DataFrame, bands: int, bucket_rows: int) -> DataFrame:
    """``(k1, k2, id, sig)``: each signature of ``bands`` bytes under the two-byte bands that it is compared in.

    Band b has the bytes b and b + 1, round the end. The signatures of a band value with more than ``bucket_rows`` of them (or a
    10,000th of all, so that the broadcast list of such values has at most 10,000 a band) are dealt by id into parts of half that size; k2 numbers
    the pairs of parts, and each signature lies in all pairs of its own part. So all signatures that agree in a band meet, in buckets of a bounded size; the rows
    of such a value grow with the square of its signatures over ``bucket_rows``.
    """
    twice = F.concat("sig", F.substring("sig", 1, 1))
    value = lambda b: F.conv(F.hex(F.substring(twice, b + 1, F.lit(2))), 16, 10).cast("int")
    number = F.array(*[value(F.lit(b)) for b in range(bands)])
    keyed = sigs.select("id", "sig", F.posexplode(number).alias("band", "value"))
    limit = max(bucket_rows, sigs.count() // 10_000)
    hot = keyed.groupBy("band", "value").count().where(F.col("count") > limit)
    hot = checkpointed(hot.select("band", "value", F.ceil(2 * F.col("count") / limit).cast("long").alias("parts")))
    k1 = (F.col("band") * (1 << 16) + F.col("value")).cast("long")
    if not hot.take(1):
        return keyed.select(k1.alias("k1"), F.lit(-1).cast("long").alias("k2"), "id", "sig")
    keyed = keyed.join(F.broadcast(hot), ["band", "value"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: p != F.col("part"))
    pairs = F.transform(others, lambda p: F.least(p, "part") * F.col("parts") + F.greatest(p, "part"))
    second = F.when(F.col("parts").isNotNull(), pairs).otherwise(F.array(F.lit(-1).cast("long")))
    return keyed.select(k1.alias("k1"), F.explode(second).alias("k2"), "id", "sig")


def first_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, bands: int = 64, bucket_rows: int = 50_000, rows_held: int = 20_000) -> DataFrame:
    """``(doc_id)``: the least id of each group of documents that steps of Jaccard ``similarity`` or more link.

    Signatures have a byte for each of ``bands`` bands of two bytes that overlap. Two documents of Jaccard similarity s, so of cosine
    2s / (1 + s), differ in a bit with probability acos(2s / (1 + s)) / pi; they are compared, by the index of their bucket, where a band
    agrees whole (at 0.8 for 98 pairs in 100), and taken up when they differ in up to the number of bits expected at ``similarity`` and two and a half standard
    deviations. Links of the buckets' spanning forests, nearest first, that are at least three deviations below the expected number count as they are; of the
    others those count whose shingle sets have the similarity, worked out from the whole texts.
    Rows of equal text are one group, null and wordless texts too. Rows of one id are one document that goes or stays as its texts
    go or stay; rows with a null id are left out; other columns are ignored; empty in, empty out.
    """
    from math import acos, pi, sqrt

    bits, p = 8 * bands, acos(2 * similarity / (1 + similarity)) / pi
    spread = sqrt(bits * p * (1 - p))
    sure, most = int(bits * p - 3 * spread), int(bits * p + 2.5 * spread)
    radii = [max(0, sure), most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [signature(t.as_py(), k, bits // 64).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary())], ["doc_id", "sig"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id is not null")
    groups = written(narrow.mapInArrow(run, "doc_id long, sig binary").groupBy("sig").agg(F.min("doc_id").alias("id")))
    keyed = bands_of(groups, bands, bucket_rows).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    links = keyed.mapInArrow(_bucket_links(radii, rows_held), "src long, dst long, bits int")
    links = written(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "bits").distinct())
    doubtful = links.where(F.col("bits") > sure).select("src", "dst")
    ids = doubtful.select(F.explode(F.array("src", "dst")).alias("doc_id"))
    texts = listed(narrow, ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    pairs = doubtful.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")
    checked = pairs.mapInArrow(_truly_similar(k, similarity), "src long, dst long")
    later = connected_components(links.where(F.col("bits") <= sure).select("src", "dst").unionByName(checked)).where("node <> component").select(F.col("node").alias("id"))
    return groups.select("id").join(later, "id", "left_anti").select(F.col("id").alias("doc_id"))
