"""Small document tables with every awkward case, and brute-force versions to hold results against."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
WORDS = "the of and river stone light house water green under morning silver quiet garden north letter".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(n: int = 120, seed: int = 5) -> list[tuple]:
    """Texts with exact copies that differ in white space, near copies, nulls, empty and very long ones."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    texts: list[str | None] = [None, "", " \t\n", "word", "two words", "é ü ß 中文 ñ", "x" * 5000, sentence(rng, 9000)]
    while len(texts) < n:
        kind = rng.random()
        old = rng.choice(texts) or "seed text"
        if kind < 0.2:
            texts.append(old)  # an exact copy
        elif kind < 0.35:
            texts.append(old.replace(" ", "\n ", 3))  # equal without white space
        elif kind < 0.5:
            texts.append(old + " " + rng.choice(WORDS))  # a near copy
        else:
            texts.append(sentence(rng, rng.randint(1, 300)))
    for i, text in enumerate(texts):
        source = [None, "a", "b", "c", "d"][min(4, int(rng.expovariate(0.7)))]
        rows.append((i * 3, text, rng.choice(["en", "de", None]), source, None if text is None else len(text)))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer() -> str:
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def components(fingerprints: dict, radius: int = 3) -> dict:
    """Smallest id reachable, by comparing all pairs."""
    best = {k: k for k in fingerprints}
    changed = True
    while changed:
        changed = False
        for a, x in fingerprints.items():
            for b, y in fingerprints.items():
                if (x ^ y).bit_count() <= radius and best[a] < best[b]:
                    best[b], changed = best[a], True
    return best
