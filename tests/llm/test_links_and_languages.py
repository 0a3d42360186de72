"""Tool-call linking and language identification: brute force, held-out accuracy and the odd cases."""

import json
import math
import random
import re
import zlib
from collections import Counter

import pytest

from latticework.llm import language_id, queries, tool_calls

LETTERS = {"aa": "abcdefg", "bb": "defghijk", "cc": "qrstuvw"}


def language_rows(n=240):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = list(LETTERS)[i % 3]
        words = ["".join(rng.choices(LETTERS[lang], k=rng.randint(2, 4))) for _ in range(rng.randint(5, 60))]
        out.append((i, " ".join(words), lang if i % 10 else None, LETTERS[lang]))
    return out


@pytest.fixture(scope="module")
def language_docs(spark):
    odd = [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 ² _ !", "bb", ""), (None, "abc abc", "aa", ""), (1003, "Ж漢字", None, ""), (1004, "qrstuv " * 50_000, None, ""), (1004, "qrstuv " * 50_000, None, "")]
    return language_rows() + odd, spark.createDataFrame(language_rows() + odd, "doc_id long, text string, lang string, held_out string")


def test_languages_of_held_out_rows(spark, language_docs, tmp_path):
    rows, df = language_docs
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_language_id(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((r[0], zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 4 == 2) for r in rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by[1004]["lang_pred"] == "cc" and by[1003]["lang_pred"] in LETTERS
    assert all(0 <= r["score"] <= 1 for r in got)
    truth = {i: list(LETTERS)[i % 3] for i in range(240)}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) / len(tested) >= 0.97


def test_backoff_takes_words_then_the_longest_known_grams():
    columns = lambda rows: tuple(map(list, zip(*rows)))
    grams = [("x", "_hel", 3), ("x", "h", 1), ("y", "h", 9), ("y", "z", 1)]
    model = language_id.Backoff({"x": 1, "y": 3}, columns([("x", "hello", 8), ("y", "hello", 1), ("y", "night", 2)]), columns(grams))
    seen, helped, hz, none = model.rows(["hello", "help", "hz", "q"])
    assert seen[0] > seen[1]
    rows = {g: model.grams[len(g)].rows[model.grams[len(g)].find([g])[1]][0] for _, g, _ in grams}
    assert helped == pytest.approx(rows["_hel"]) and hz == pytest.approx((rows["h"] + rows["z"]) / 2) and (none == 0).all()
    small, large = language_id.Scorer(model, remembered=1), language_id.Scorer(model)
    for text in ("help hello q help hz", "night q", "hz hz z", None, "7"):
        assert small.score(text) == large.score(text)


def brute_scores(rows, orders=(5, 4, 3, 2, 1)):
    """Posterior shares of each text from plain counts of all learned rows."""
    learned = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 4 != 2]
    langs = sorted({r[2] for r in learned})
    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for r in learned:
        words[r[2]].update(re.findall(r"[^\W\d_]+", r[1].lower()))
    for x in langs:
        for w, n in words[x].items():
            for k in orders:
                for i in range(len(w) + 2 - k + 1):
                    grams[x][f"_{w}_"[i : i + k]] += n
    size = lambda tables, k: len({t for x in langs for t in tables[x] if k is None or len(t) == k})
    total = lambda table, k: sum(n for t, n in table.items() if k is None or len(t) == k)
    log = lambda tables, x, t, k: math.log((tables[x][t] + 0.5) / (total(tables[x], k) + 0.5 * size(tables, k)))
    out = []
    for r in rows:
        found = re.findall(r"[^\W\d_]+", (r[1] or "").lower())
        s = {x: math.log(sum(q[2] == x for q in learned) / len(learned)) for x in langs}
        for w in found:
            if any(words[x][w] for x in langs):
                for x in langs:
                    s[x] += log(words, x, w, None)
                continue
            for k in orders:
                own = [g for i in range(len(w) + 2 - k + 1) if any(grams[x][g := f"_{w}_"[i : i + k]] for x in langs)]
                if own:
                    for x in langs:
                        s[x] += sum(log(grams, x, g, k) for g in own) / len(own)
                    break
        best = max(s, key=s.get)
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())) if found else ("und", 0.0))
    return out


def test_scores_are_those_of_plain_counts(spark):
    rows = [r[:3] for r in language_rows(60)] + [(77, "abq qax def", None), (78, "zzz", "aa"), (79, None, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, language_id.fit(df)).collect()}
    for r, (lang, score) in zip(rows, brute_scores(rows)):
        assert got[r[0]][0] == lang and got[r[0]][1] == pytest.approx(score, abs=1e-4), r


def test_learned_share_does_not_vanish_in_large_tables(spark, language_docs):
    rows, df = language_docs
    few = language_id.fit(df, sample_docs=20)
    assert 0 < len(few.words.keys) < len(language_id.fit(df).words.keys)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, few).collect()}
    tested = [(got[i], list(LETTERS)[i % 3]) for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in tested) / len(tested) >= 0.95


def test_nothing_learned_or_no_rows(spark, none):
    model = language_id.fit(none)
    assert language_id.identify(none, model).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert language_id.identify(one, model).first()["lang_pred"] == "und"


def linked(spark, calls, results, schemas):
    calls = [(a, b, c if isinstance(c, list) or c is None else [c], *rest) for a, b, c, *rest in calls]
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, needs array<string>, name string, arguments map<string,string>, depth string")
    results = spark.createDataFrame(results, "call_id string, content string, status string")
    schemas = spark.createDataFrame(schemas, "name string, required array<string>, kinds map<string,string>, result string")
    return tool_calls.linked(calls, results, schemas)


def test_call_verdicts_order_and_json(spark):
    schemas = [("add", ["a"], {"a": "integer", "b": "number", "s": "string"}, "")]
    calls = [
        (1, "c1", None, "add", {"b": "-1.5", "a": "2", "s": 'q"\\\n é'}, ""), (1, "c2", "c1", "add", {"a": "x"}, ""), (1, "c3", "c2", "add", {"b": "1"}, ""),
        (1, "c4", "c3", "add", {"a": "1", "z": "1"}, ""), (1, "c5", "gone", "none", None, ""), (2, "k1", "k2", "add", {"a": "1"}, ""), (2, "k2", "k1", "add", {"a": "1"}, ""),
        (2, "k3", "k3", "add", {"a": "1"}, ""), (3, "d", None, "add", {"a": "1"}, ""), (3, "d", None, "add", {"a": "1"}, ""), (3, None, None, "add", {"a": "1"}, ""), (None, "e", "c4", "add", {"a": "1"}, ""),
        (3, "n", None, None, {"a": None}, ""), (3, "m", None, "add", {"a": None}, ""),
    ]
    results = [("c1", "later", ""), ("c1", "early", ""), ("d", "x", ""), (None, "lost", ""), ("c2", None, ""), ("k1", "r", "")]
    got = linked(spark, calls, results, schemas).collect()
    assert len(got) == len(calls)
    by = {r["call_id"]: r for r in got}
    assert {k: r["status"] for k, r in by.items()} == {
        "c1": "ok", "c2": "invalid_arguments", "c3": "invalid_arguments", "c4": "invalid_arguments", "c5": "unknown_tool", "k1": "cycle", "k2": "cycle",
        "k3": "cycle", "d": "duplicate_id", None: "no_id", "e": "no_result", "n": "unknown_tool", "m": "invalid_arguments",
    }
    assert [by[k]["depth"] for k in ("c1", "c2", "c3", "c4", "e", "c5", "d", "k1", "k3")] == [0, 1, 2, 3, 4, 0, 0, -1, -1]
    assert by["c1"]["n_results"] == 2 and by["c5"]["n_results"] == 0
    assert by["c1"]["json"] == '{"arguments":{"a":2,"b":-1.5,"s":"q\\"\\\\\\n é"},"id":"c1","name":"add","result":"early"}'
    for r in got:
        parsed = json.loads(r["json"])
        assert list(parsed) == ["arguments", "id", "name", "result"] and list(parsed["arguments"]) == sorted(parsed["arguments"])


def test_a_long_chain_and_empty_tables(spark):
    n = 300
    calls = spark.createDataFrame([(1, f"c{i}", [f"c{i - 1}"] if i else None) for i in range(n)], "conv_id long, call_id string, needs array<string>")
    assert {r["call_id"]: r["depth"] for r in tool_calls.depths(calls).collect()} == {f"c{i}": i for i in range(n)}
    assert linked(spark, [], [], []).count() == 0


def brute_depths(needs):
    """Longest run of needs below each call, -1 where there is a cycle."""
    depth = {c: -1 for c in needs}
    for _ in needs:
        for c, own in needs.items():
            own = [n for n in own if n in needs]
            if all(depth[n] >= 0 for n in own):
                depth[c] = 1 + max((depth[n] for n in own), default=-1)
    return depth


def test_depths_of_several_needs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        needs = {f"c{i}": [f"c{rng.randrange(i)}" for _ in range(rng.choice([1, 1, 1, 1, 2, 3]))] if i and rng.random() < 0.9 else [] for i in range(60)}
        needs |= {"a": ["b"], "b": ["a"], "d": ["a", "c3"], "e": ["d"], "f": ["e", "f"], "g": ["gone", "c5"], "h": ["h"]}
        calls = spark.createDataFrame([(c, [*n, None]) for c, n in needs.items()], "call_id string, needs array<string>")
        assert {r["call_id"]: r["depth"] for r in tool_calls.depths(calls).collect()} == brute_depths(needs)


def test_numbers_are_json_and_calls_have_places(spark):
    schemas = [("f", [], {"x": "number", "n": "integer"}, ""), ("f", ["zz"], {"x": "string"}, "")][:1]
    values = ["-0", "007", "1.50", "1E+05", "-0.0", "1e-007", "2e0", "0.0e5", ".5", "1.", "+1", "12", "10", "1e5\n"]
    calls = [(1 + i % 2, f"k{i:02}", None, "f", {"x": v}, "") for i, v in enumerate(values)] + [(1, "z", "k00", "f", {}, "")]
    got = {r["call_id"]: r for r in linked(spark, calls, [(c[1], "r", "") for c in calls], schemas).collect()}
    status = {v: got[f"k{i:02}"]["status"] for i, v in enumerate(values)}
    assert {v for v, s in status.items() if s == "ok"} == {"-0", "1.50", "1E+05", "-0.0", "1e-007", "2e0", "0.0e5", "12", "10"}
    text = {v: got[f"k{i:02}"]["json"].split('"x":')[1].split("}")[0] for i, v in enumerate(values)}
    assert [text[v] for v in ("-0", "1.50", "1E+05", "-0.0", "1e-007", "2e0", "0.0e5", "10")] == ["0", "1.5", "1e5", "0", "1e-7", "2", "0", "10"]
    for r in got.values():
        json.loads(r["json"])
    for conv in (1, 2):
        own = sorted((r["depth"], r["call_id"]) for r in got.values() if r["conv_id"] == conv)
        assert [got[c]["place"] for _, c in own] == list(range(len(own)))


def test_turns_of_conversations(spark, tmp_path):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", "hi there"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (1, 3, "user", None), (None, 1, "user", "x"), (2, 1, "user", "y " * 30_000), (2, 2, "assistant", None), (3, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_tool_calls(spark, str(tmp_path)).collect()
    assert Counter((r["call_id"], r["status"]) for r in got) == Counter({("c1t0", "no_result"): 1, ("c1t1", "ok"): 1, ("c1t3", "duplicate_id"): 2, (None, "no_id"): 1, ("c2t1", "ok"): 1})
    assert {r["call_id"]: r["depth"] for r in got if r["call_id"]} == {"c1t0": 0, "c1t1": 0, "c1t3": 1, "c2t1": 0}
    assert all(json.loads(r["json"]) for r in got)
