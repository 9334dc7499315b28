import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, uid int, key string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, empties, copies, near copies, shared passages, one very long text and a hot source."""
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(5, 120)) for _ in range(60)]
    passage = words(rng, 45)
    texts += [texts[0]] * 6 + [texts[1] + " tail", texts[1].upper(), None, "", " \n\t ", "one", "one two three", "Ünïcode Straße " * 12]
    texts += [f"{words(rng, 12)} {passage} {words(rng, 9)}" for _ in range(5)] + [" ".join(["zu"] * 130), words(rng, 20_000, 9)]
    out = []
    for i, text in enumerate(texts):
        out.append((i * 3 + 1, text, None if i % 11 == 0 else "ab"[i % 2], "hot" if i % 3 else None if i % 6 == 0 else f"s{i % 4}", len(text or ""), 0.5, "x", i, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
