"""The near-dedup stage of the pipeline against brute force, and on odd rows."""

import random

from latticework.llm import simhash_dedup


def words(n, rng):
    return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def pairs(n, seed):
    """Texts 2i and 2i + 1 with some words changed, and their similarity."""
    rng, texts, similar = random.Random(seed), [], {}
    for i in range(n):
        a = words(rng.choice([60, 150, 300]), rng)
        b = list(a)
        for _ in range(max(1, int(len(a) * rng.uniform(0.005, 0.04)))):
            b[rng.randrange(len(b))] = f"changed{rng.randrange(999)}"
        texts += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        similar[2 * i + 1] = jaccard(a, b)
    return texts, similar


def test_recall_from_the_limit_on_and_no_false_pairs(spark):
    texts, similar = pairs(300, 1)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for bucket_rows in (50_000, 3):  # whole and split buckets
        kept = {r[0] for r in simhash_dedup.first_of_similar(df, bucket_rows=bucket_rows).collect()}
        near = [i for i, s in similar.items() if 0.8 <= s < 0.85]
        assert len(near) > 40 and sum(i not in kept for i in near) >= 0.9 * len(near)
        assert all(i not in kept for i, s in similar.items() if s >= 0.9)
        assert all(i in kept for i, s in similar.items() if s < 0.8)
        assert {i for i, _ in texts if i % 2 == 0} <= kept


def test_a_large_group_of_near_copies_keeps_its_first(spark):
    rng = random.Random(2)
    base, texts = words(200, rng), []
    for i in range(1500):
        own = list(base)
        own[rng.randrange(200)] = f"own{i}"
        texts.append((5000 - i, " ".join(own)))
    texts += [(9000 + i, " ".join(words(80, rng))) for i in range(50)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for bucket_rows in (50_000, 100):
        kept = sorted(r[0] for r in simhash_dedup.first_of_similar(df, bucket_rows=bucket_rows).collect())
        assert kept == [3501, *range(9000, 9050)]


def test_signatures_that_agree_in_one_crowded_band_alone_meet(spark):
    rng = random.Random(3)
    sigs = [(i, bytearray(rng.randrange(256) for _ in range(64))) for i in range(40)]
    for _, s in sigs:
        s[10:12] = b"ab"
    df = spark.createDataFrame(sigs, "id long, sig binary")
    met, most = set(), 0
    buckets = {}
    for r in simhash_dedup.bands_of(df, 64, 8).collect():
        buckets.setdefault((r["k1"], r["k2"]), []).append(r["id"])
    for (k1, _), ids in buckets.items():
        if k1 >> 16 == 10:
            met |= {(a, b) for a in ids for b in ids if a < b}
            most = max(most, len(ids))
    assert met == {(a, b) for a in range(40) for b in range(a + 1, 40)} and most <= 20


def test_odd_rows(spark, docs, none):
    kept = [r[0] for r in simhash_dedup.first_of_similar(docs).collect()]
    assert len(kept) == len(set(kept)) and None not in kept
    texts = [(1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "Two WORDS"), (6, "x " * 50_000), (7, "x " * 50_000), (8, "other words")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r[0] for r in simhash_dedup.first_of_similar(df).collect()) == [1, 4, 6, 8]
    assert simhash_dedup.first_of_similar(none).count() == 0
