from __future__ import annotations

import random

import pytest

# Columns with the names that the operators use inside.
EXTRA = "id long, local string, bytes string, fp string, row string, _lost long, u double, kept string, place string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(n: int, seed: int = 1) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))


def rows_with_edges() -> list[tuple]:
    long = words(20_000, 9)
    passage = words(60, 3)
    texts = [
        (1, "The quick brown fox, jumps.", "a"), (2, "the quick  brown\tfox, jumps.", "a"), (3, "The quick brown fox, jumps.", None),
        (4, None, "b"), (5, "", "b"), (6, " \n\t ", "c"), (7, long, "c"), (8, long + " tail", "a"), (9, "Émile naïve ß 一二三 🙂", "d"),
        (10, passage + " one", "a"), (11, "two " + passage, "a"), (11, "two " + passage, "a"), (12, "w", "z"), (None, "no id", "a"),
        (None, "The quick brown fox, jumps.", "b"), (13, "a\u0000b <|endoftext|> </s>[INST]", ""), (14, "aaaa" * 100, "a"),
    ]
    return [(i, t, "en", s, len(t or ""), i, "x", "y", "z", "q", i, 0.5, "k", "p") for i, t, s in texts]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(rows_with_edges(), SCHEMA).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
