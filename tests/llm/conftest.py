import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an the re ing tion ou ble st wh ed ly or".split()


def sentence(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def rows(seed=5, n=120):
    """Random texts, exact and near copies, and the odd cases: null, empty, blank, very long, repeated rows, null ids."""
    rng = random.Random(seed)
    shared = "Shared Line of nine words that many pages carry."
    out = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(3, 40)) + "." for _ in range(rng.randint(1, 8)))
        if i % 4 == 0:
            text += "\n" + shared
        if i % 5 == 1 and out:
            words = rng.choice(out)[1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 7 == 2 and out:
            text = rng.choice(out)[1]
        out.append((i, text, rng.choice(["en", "fr", None]), f"src{i % 3}", len(text)))
    long_ = sentence(rng, 30_000)
    odd = [(n, None, None, None, None), (n + 1, "", "en", "src0", 0), (n + 2, " \t\n\x0b ", "fr", "src1", 5), (n + 3, long_, "en", "src2", len(long_)), (None, "no id here", "en", None, 10), (n + 4, "İstanbul ß ſ K é   \x1c\x85 漢字 é 1²", "fr", "src0", 9)]
    return out + odd + odd[-1:] + out[:2]


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    """The rows, with further columns whose names the operators use themselves."""
    clash = "uid fp component_id block shard slot size kept row spans items lines host kind _cell _rank n_words word"
    return spark.createDataFrame(data, SCHEMA).selectExpr("*", *[f"'x' as {c}" for c in clash.split()]).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
