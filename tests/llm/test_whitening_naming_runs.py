"""The operators of whitening, block naming and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import block_naming, embedding_whitening, periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs


def plain_runs(w, periods, least):
    out = set()
    for p in range(1, len(w) // 2 + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            if j > i:
                out.add((i - p, j - i + p, p))
            i = j + 1
    smallest = lambda s, n, p: not any(all(w[t] == w[t - q] for t in range(s + q, s + n)) for q in range(1, p))
    return sorted((s, n, p) for s, n, p in out if n >= max(least, periods * p) and smallest(s, n, p))


def plain_kept(w, runs):
    cut = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in cut]


@pytest.mark.parametrize("periods,least", [(4, 6), (2, 1), (3, 5)])
def test_runs_are_the_plain_ones(periods, least):
    rng = random.Random(periods)
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(letters) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            u, at = [rng.randrange(letters) for _ in range(rng.randint(1, 9))], rng.randint(0, len(w))
            w[at:at] = u * rng.randint(1, 6) + u[: rng.randint(0, len(u))]
        runs = periodic_runs.found(w, periods, least)
        assert runs == plain_runs(w, periods, least)
        assert periodic_runs.kept(w, runs) == plain_kept(w, runs)


def test_long_runs():
    rng = random.Random(2)
    part = [rng.randrange(500) for _ in range(1500)]
    assert periodic_runs.found(part + part * 5 + part[:10]) == [(0, 9010, 1500)]
    assert periodic_runs.found(["a"] * 30_000) == [(0, 30_000, 1)]


def plain_query(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    from latticework.llm.periodic_runs import found

    runs = plain_runs(w, 4, 6) if n < 300 else found(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(told), sha(" ".join(plain_kept(w, runs))))


def test_runs_query(spark, data, tmp_path):
    rng = random.Random(4)
    more = [(1000 + i, " ".join(rng.choices("ab", k=rng.randint(0, 90))) + "\t" + "x y " * rng.randint(0, 9), None, None, None) for i in range(200)]
    spark.createDataFrame(data + more, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(plain_query(r[0], r[1]) for r in data + more)
    assert sum(1 for r in got if r[1] > 1) > 10


def test_runs_keep_the_columns(spark, docs, none):
    out = periodic_runs.periodic_runs(docs.withColumn("start", F.lit(1)))
    assert out.columns == [*docs.columns, "start", "runs", "collapsed"] and out.count() == docs.count()
    assert periodic_runs.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs.withColumn("runs", F.lit(1)))


# ---- block naming


def plain_duplicates(rows):
    groups, out = defaultdict(list), Counter()
    for i, x in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", x or "")].append((-len(x or ""), i is None, i or 0, i))
    for text, own in groups.items():
        best, sha = min(own), hashlib.sha256(text.encode()).hexdigest()
        out[(best[3], best[3], len(own), True, sha)] += 1
        out.update((r[3], best[3], len(own), False, sha) for r in own)
        out[(best[3], best[3], len(own), False, sha)] -= 1
    return +out


NAMES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("size", [1, 3, 256])
def test_duplicates_are_the_plain_ones(spark, size):
    """Many equal blocks: one that a third of the rows hold, so that it lies on both sides of a task's border."""
    rng = random.Random(size)
    texts = [None, "", " ", "\t\n"] + ["".join(rng.choices("ab \n漢😀", k=rng.choice([1, 2, 3, 5, 9, 17, 40]))) for _ in range(300)]
    texts += [x and x + " " for x in rng.choices(texts, k=200)] + ["ab" * 300] * 250 + ["ab" * 299 + "a "] * 3 + ["aa" * 150, "a" * 299]
    rows = [(rng.choice([None, i // 2]) if rng.random() < 0.1 else i, x) for i, x in enumerate(texts)]
    got = block_naming.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size).collect()
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == plain_duplicates(rows)


def test_duplicates_of_odd_rows(spark, docs, data, none):
    got = block_naming.exact_duplicates(docs).collect()
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == plain_duplicates([r[:2] for r in data])
    rest = block_naming.deduplicated(docs)
    assert rest.columns == docs.columns
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]", "", x or "")
    assert Counter(plain(r["text"]) for r in rest.collect()) == Counter({plain(r[1]): 1 for r in data})
    assert block_naming.exact_duplicates(none).count() == 0 and block_naming.deduplicated(none).count() == 0
    with pytest.raises(ValueError):
        block_naming.identities(docs.withColumn("row", F.lit(1)))


def test_duplicates_sql(spark, data, tmp_path):
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(NAMES)} from ({queries.ORACLES['op12_block_naming']})").fetchall()
    assert Counter(tuple(r[c] for c in NAMES) for r in queries.op12_block_naming(spark, str(tmp_path)).collect()) == Counter(want)


# ---- whitening


def truth(rows):
    x = [np.floor(256 * np.array(r, dtype=float)).astype(np.int64) for r in rows]
    distinct = np.array(sorted({tuple(r.tolist()) for r in x}))
    n, sums = len(distinct), distinct.sum(axis=0)
    c = distinct - sums / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return x, n, [int(s) for s in sums], e[::-1], q[:, ::-1].T


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [None if c is None else float(c) for c in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").repartition(3)


CASES = {
    "wide": np.random.default_rng(1).standard_normal((90, 12)) * np.linspace(3, 0.2, 12),
    "ties": np.vstack([s * np.eye(6) * 3.0 for s in (1, -1)]),
    "dependent": np.random.default_rng(0).integers(-8, 8, (50, 2)) @ np.random.default_rng(3).integers(-2, 3, (2, 7)) / 4.0,
    "uneven": np.random.default_rng(5).standard_normal((60, 3)) * [1000, 1, 0.1],
    "few": np.random.default_rng(6).standard_normal((3, 5)),
    "one row": np.ones((4, 3)),
}


@pytest.mark.parametrize("name", CASES)
def test_whitening_is_the_plain_one(spark, name):
    rows = [list(map(float, np.float32(r))) for r in CASES[name]]
    rows += rows[:3]  # repeated rows count once
    x, n, sums, e, q = truth(rows)
    rank = min(4, int((e > 1e-9 * max(e[0], 1)).sum()))
    model = embedding_whitening.fit(vectors(spark, rows))
    assert (model.n, model.sums, len(model.values)) == (n, sums, rank)
    assert np.allclose(model.values, e[:rank], rtol=1e-9) and model.identity_error < 1e-9
    if name != "ties":
        assert all(min(abs(model.components[i] - q[i]).max(), abs(model.components[i] + q[i]).max()) < 1e-9 for i in range(rank))
    got = {r["vec_id"]: r for r in embedding_whitening.whitened(vectors(spark, rows), model).collect()}
    assert len(got) == len(rows)
    for i, v in enumerate(x):
        assert got[i]["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(v, sums))
        assert np.allclose(got[i]["whitened"], model.components @ (v - model.means) / np.sqrt(model.values), rtol=1e-9, atol=1e-9)


def test_whitening_query_leaves_out_unusable_rows(spark, tmp_path):
    good = [[1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [2.0, 2.0, 2.0], [-4.0, 0.0, 1.0], [0.0, 1.0, 0.0]]
    rows = good + [None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [], [1.0, 2.0]]
    frame = vectors(spark, rows).withColumn("whitened", F.lit("x")).withColumn("deviation", F.lit("x")).withColumn("_x", F.lit(1))
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_whitening(spark, str(tmp_path)).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == {(i, c) for i in range(5) for c in (1, 2, 3)} and len(got) == 15
    assert all(r["n"] == 5 and r["identity_error"] < 1e-9 for r in got)
    assert abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-9
    assert embedding_whitening.whitened(frame.drop("whitened", "deviation"), embedding_whitening.fit(frame)).columns == ["vec_id", "embedding", "_x", "whitened", "deviation"]
    with pytest.raises(ValueError):
        embedding_whitening.whitened(frame, embedding_whitening.fit(frame))


def test_whitening_of_nothing(spark, tmp_path):
    empty = vectors(spark, [None])
    assert embedding_whitening.fit(empty) is None and embedding_whitening.whitened(empty, None).count() == 0
    empty.where("vec_id > 5").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op11_whitening(spark, str(tmp_path)).collect() == []
