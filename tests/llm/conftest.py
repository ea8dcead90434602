from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def corpus(seed: int = 1, size: int = 120) -> list[tuple]:
    """Rows with copies, near copies, shared passages, null and empty texts, null and repeated ids, one very long text, and a clashing column."""
    rnd = random.Random(seed)
    words = ["the", "of", "and", "Über", "naïve", "x.", "12", "日本", "a&b", "<|im_end|>"] + [f"w{k}" for k in range(60)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    texts = []
    for _ in range(size):
        n = rnd.choice([1, 2, 5, 30, 80])
        body = [rnd.choice(words) for _ in range(n)]
        kind = rnd.random()
        if kind < 0.2 and texts:
            body = rnd.choice(texts).split(" ")
            if rnd.random() < 0.6:
                body[rnd.randrange(len(body))] = "CHANGED"
        elif kind < 0.4:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        texts.append((" " if kind < 0.9 else " \n\t").join(body))
    texts += ["", "   ", "one", " ".join(rnd.choice(words) for _ in range(30_000))]
    rows = [(k * 3, t, rnd.choice(["en", "de", None]), "s", len(t), "old") for k, t in enumerate(texts)]
    rows += [(1, None, None, None, None, None), (None, passage + " tail", "en", "s", 1, "x"), rows[5], rows[5], (rows[7][0], passage, "en", "s", 0, "y")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
