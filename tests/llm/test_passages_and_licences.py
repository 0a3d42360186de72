import random

import corpus_pipeline
import numpy as np
import pytest
from latticework.llm import licence_scan, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LICENCE = next(iter(licence_scan.TEMPLATES.values()))[0]


def words(n, seed):
    """Words that are unlikely to repeat."""
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)


def test_shared_passages_are_found_and_others_are_not(spark):
    same = words(80, 1)
    fuzzy = list(same)
    fuzzy[40] = "changed"
    texts = [(1, " ".join(words(50, 2) + same + words(50, 3))), (2, " ".join(words(20, 4) + same + words(30, 5))), (3, " ".join(words(10, 6) + fuzzy)), (4, " ".join(words(200, 7)))]
    found = {(r["doc_id"], r["other_doc_id"]): r for r in substring_dedup.passages(table(spark, texts)).collect()}
    assert set(found) == {(2, 1), (3, 1), (3, 2)}
    assert found[2, 1][1:3] == (20, 100) and found[2, 1][4:] == (50, 130, 80, 1.0)
    assert found[3, 1][1:3] == (10, 90) and found[3, 1]["n_equal"] == 79 and found[3, 1]["identity"] == pytest.approx(79 / 80)


def test_many_copies_give_links_to_the_first_and_the_one_before(spark):
    text = " ".join(words(100, 8))
    got = substring_dedup.passages(table(spark, [(i, text) for i in range(40)])).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(i, j) for i in range(1, 40) for j in (0, i - 1)} and len(got) <= 2 * 39


def brute_best_score(x, end, y, k, gap):
    """Best chain score over all pairs of blocks."""
    at = sorted(zip(x, end, y))
    score = []
    for i, (a, e, b) in enumerate(at):
        before = [score[j] - gap * (a - (f - k) + b - (d + f - c - k)) for j, (c, f, d) in enumerate(at[:i]) if f - k < a and d + f - c - k < b]
        score.append(e - a + max([0.0, *before]))
    return max(score)


def test_best_chain_is_that_of_brute_force():
    for seed in range(200):
        rng = random.Random(seed)
        found = {(i, i + rng.choice([5, 5, 7, 12, 30]), max(0, i // rng.choice([1, 1, 2]) + rng.choice([0, 0, 0, 7, -30, 60]))) for i in rng.sample(range(400), 60)}
        x, end, y = (np.array(v) for v in zip(*sorted(found)))
        paths = substring_dedup.chains(x, end, y, 5, 0.05)
        assert sorted(i for p in paths for i in p) == list(range(len(x)))
        p = np.array(paths[0])
        assert brute_best_score(x[p], end[p], y[p], 5, 0.05) == pytest.approx(brute_best_score(x, end, y, 5, 0.05))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_words_between_blocks_have_the_fewest_edits():
    for seed in range(200):
        rng = random.Random(seed)
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 8))] for _ in range(2))
        columns = substring_dedup._between(a, b)
        assert sum(c[1] for c in columns) == len(a) and sum(c[2] for c in columns) == len(b)
        assert sum(1 - c[0] for c in columns) == edits(a, b)


def changed(p, share, rng):
    q = []
    for w in p:
        q += rng.choice([[f"new{rng.randrange(9999)}"], [f"new{rng.randrange(9999)}"], [], [w, "ins"]]) if rng.random() < share else [w]
    return q


def test_recall_of_fuzzy_passages_against_brute_force(spark):
    rng, texts, pairs = random.Random(1), {}, []
    for i in range(0, 480, 2):
        p = words(rng.choice([40, 60, 120]), 5000 + i)
        q = changed(p, rng.choice([0, 0.04, 0.08, 0.12]), rng)
        texts[i], texts[i + 1] = words(rng.randint(0, 60), 6000 + i) + p + words(30, 7000 + i), words(rng.randint(0, 60), 8000 + i) + q + words(30, 9000 + i)
        if min(len(p), len(q)) >= 30 and edits(p, q) <= 0.2 * max(len(p), len(q)):
            pairs.append((i + 1, i, q, p))
    got = {(r["doc_id"], r["other_doc_id"]): r for r in substring_dedup.passages(table(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()}
    assert len(pairs) > 150 and sum(p[:2] in got for p in pairs) >= 0.9 * len(pairs)
    assert all(i == j + 1 and j % 2 == 0 for i, j in got)
    for (i, j), r in got.items():
        a, b = texts[i][r["start"] : r["end"]], texts[j][r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 30 and r["identity"] >= 0.8
        assert edits(a, b) <= round(r["n_equal"] / r["identity"]) - r["n_equal"]  # no alignment has more equal words than columns


def test_holders_that_overlap(spark):
    """75 words that two documents share, of which five earlier ones hold pieces of 15 words."""
    p = words(75, 31)
    texts = [(i, " ".join(words(40, 40 + i) + p[15 * i : 15 * i + 15] + words(40, 50 + i))) for i in range(5)]
    texts += [(8, " ".join(words(40, 60) + p + words(40, 61))), (9, " ".join(words(50, 62) + p))]
    got = [r for r in substring_dedup.passages(table(spark, texts)).collect() if r["doc_id"] == 9]
    assert [(r["start"], r["end"], r["other_doc_id"], r["other_start"], r["other_end"]) for r in got] == [(50, 125, 8, 40, 115)]


def test_passages_whose_halves_others_hold(spark):
    """Two documents share a passage; others before and between them hold its halves, in few and in many copies.

    With many copies, a pair needs a common seed in each half; at 50 words with one in ten changed, one half in twelve has none.
    """
    texts, planted = [], {}
    kinds = [(n, one_in, holders) for n, one_in in ((32, 0), (36, 0), (40, 0), (48, 0), (50, 10), (54, 9), (60, 12)) for holders in (2, 40)]
    for case in range(len(kinds) * 20):
        n, one_in, holders = kinds[case % len(kinds)]
        rng, base = random.Random(case), 100_000 * case
        p = words(n, base)
        q = [f"new{rng.randrange(9999)}" if one_in and i % one_in == one_in // 2 else w for i, w in enumerate(p)]
        around = lambda part, i: " ".join(words(10, base + 2 * i + 1) + part + words(10, base + 2 * i + 2))  # noqa: E731, B023
        before, after = range(10, 10 + holders // 2), range(3000, 3000 + holders // 2)
        texts += [(base + i + 500 * j, around(half, i + 500 * j)) for i in (*before, *after) for j, half in enumerate((p[: n // 2], p[n // 2 :]))]
        texts += [(base + 1500, around(p, 1500)), (base + 9000, around(q, 9000))]
        planted[base + 9000, base + 1500] = kinds[case % len(kinds)]
    got = {(r["doc_id"], r["other_doc_id"]) for r in substring_dedup.passages(table(spark, texts)).collect()}
    found = {kind: sum(k == kind and pair in got for pair, k in planted.items()) for kind in kinds}
    least = {kind: 12 if kind == (50, 10, 40) else 18 for kind in kinds}
    assert all(found[kind] >= least[kind] for kind in kinds), found


def test_no_pair_of_different_texts_is_left_out(spark):
    """Groups of 10 and of 50 documents, each with its own changes of a text and no equal run of 30 words: all pairs are passages, not only those with the first and the one before."""
    texts, expected = [], set()
    for base, many in ((0, 10), (1000, 50)):
        p = words(100, 21 + base)
        for i in range(base, base + many):
            own = list(p)
            for at in range(10, 100, 20):
                own[at + random.Random(i + at).randrange(4)] = f"own{i}"
            texts.append((i, " ".join(words(20, 5000 + i) + own + words(20, 9000 + i))))
            expected |= {(i, j) for j in range(base, i)}
    got = {(r["doc_id"], r["other_doc_id"]) for r in substring_dedup.passages(table(spark, texts)).collect()}
    assert got == expected


def test_passages_after_a_left_out_middle_and_next_to_each_other(spark):
    a, b, c = words(1000, 11), words(400, 12), words(400, 13)
    texts = [(1, " ".join(a)), (2, " ".join(a[:500] + a[600:])), (3, " ".join(b + c)), (4, " ".join(c + b))]
    got = substring_dedup.passages(table(spark, texts)).collect()
    for doc, first, second in ((2, (0, 500), (500, 900)), (4, (0, 400), (400, 800))):
        for start, end in (first, second):
            assert any(r["doc_id"] == doc and r["start"] <= start + 9 and r["start"] >= start - 9 and abs(r["end"] - end) <= 9 for r in got)


def test_equal_runs_are_found_whoever_holds_their_seeds_first(spark):
    p = words(58, 14)
    texts = {1: p[:29], 2: p[29:], 3: list(p), 4: list(p)}
    rng, long_ = random.Random(15), words(300, 16)
    for i in range(5, 40):  # pieces of one text in any order, so that holders overlap
        texts[i] = []
        for _ in range(3):
            a = rng.randrange(260)
            texts[i] += long_[a : a + rng.randint(20, 90)] + words(10, 100 * i + a)
    got = substring_dedup.passages(table(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()
    assert any((r["doc_id"], r["other_doc_id"]) == (4, 3) and r["start"] == 0 and r["end"] == 58 for r in got)
    for i, t in texts.items():
        covered = {w for r in got if r["doc_id"] == i for w in range(r["start"], r["end"])}
        for j in range(1, i):
            for d in range(-len(t), len(texts[j])):  # equal runs on the diagonal
                run = 0
                for x in range(len(t) + 1):
                    if x < len(t) and 0 <= x + d < len(texts[j]) and t[x] == texts[j][x + d]:
                        run += 1
                        continue
                    if run >= 49:
                        assert covered >= set(range(x - run + 9, x - 9)), (i, j, x - run, x)
                    run = 0


def test_a_repeated_word_gives_few_passages(spark):
    got = substring_dedup.passages(table(spark, [(1, "no " * 400), (2, "no " * 500 + " ".join(words(40, 3))), (3, "a b " * 300), (4, " ".join(words(20, 4)) + " a b" * 200)])).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == {(2, 1), (4, 3)}
    assert {w for r in got if r["doc_id"] == 2 for w in range(r["start"], r["end"])} >= set(range(491)) and len(got) < 90


def test_passages_of_odd_rows(docs, none):
    got = substring_dedup.passages(docs).collect()
    assert all(r["doc_id"] is not None and r["other_doc_id"] < r["doc_id"] for r in got)
    assert substring_dedup.passages(none).count() == 0


@pytest.fixture(scope="module")
def model(docs):
    return licence_scan.train(docs)


def test_licence_lines_are_found(spark, model):
    texts = [(1, "Some words first.\n" + LICENCE), (2, " ".join(words(200, 9))), (3, None), (4, ""), (5, LICENCE), (5, LICENCE)]
    got = licence_scan.scan(table(spark, texts), model).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 5, 5]
    assert {r["family"] for r in got} == {next(iter(licence_scan.TEMPLATES))} and all(r["confirmed"] for r in got)


def test_all_lines_are_learnt_from(spark):
    rare = "this software is distributed by hand"
    texts = [(i, "plain words\nmore of them") for i in range(5000)] + [(6000 + i, rare) for i in range(30)] + [(7000, LICENCE), (7001, None)]
    df = table(spark, texts)
    got = {tuple(r["terms"]): r["n"] for r in licence_scan.ordinary(df).collect()}
    assert got[()] == 10_000 and len(got) == 2 and sum(got.values()) == 10_030
    weights, bias, limit = licence_scan.train(df)
    others, bias2, limit2 = licence_scan.train(df.withColumn("doc_id", df.doc_id + 10**6))  # no draw by ids
    assert all(a[1] == pytest.approx(b[1], abs=1e-6) for a, b in zip(weights, others))
    assert bias == pytest.approx(bias2, abs=1e-6) and limit == pytest.approx(limit2, abs=1e-6)


def test_threshold_leaves_the_exact_share_above(spark):
    scores = spark.createDataFrame([(0.2, 500.0), (0.6, 5.0), (0.7 + 1e-12, 2.0), (0.7, 3.0), (0.9, 1.0)], "p double, n double")
    assert [licence_scan._least_above(scores, a) for a in (0, 1, 3, 6, 10.5, 11)] == [0.9, 0.7 + 1e-12, 0.7, 0.6, 0.6, 0.5]


def test_licences_of_odd_rows(docs, none, model):
    assert licence_scan.scan(docs, model).count() == 0
    assert licence_scan.scan(none, model).count() == 0
    assert licence_scan.scan(none, licence_scan.train(none)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_of_odd_rows(spark, docs, none, tmp_path, name, stage):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, none):
        out = stage(spark, given, str(tmp_path))
        assert out.columns == given.columns and out.count() <= given.count()
