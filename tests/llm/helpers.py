"""Small corpora, and the tables that every operator must survive."""

from __future__ import annotations

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: int, vocabulary: list[str]) -> str:
    return " ".join(rng.choice(vocabulary) for _ in range(words)).capitalize() + "."


def vocabulary(rng: random.Random, letters: str, n: int = 300) -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def rows(texts: list, langs: list | None = None, first: int = 0) -> list[tuple]:
    return [(first + i, t, langs[i] if langs else "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]


def frame(spark, data: list[tuple]):
    return spark.createDataFrame(data, DDL)


def awkward(long: int = 20_000) -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long one, repeated rows and a doc_id with two texts."""
    body = "The quick brown fox jumps over the lazy dog near the river bank today.\nAnother line that is long enough to count here."
    return [
        (1, body, "en", "s", 100),
        (1, body, "en", "s", 100),
        (2, body, None, None, None),
        (3, None, "en", "s", None),
        (4, "", "en", "s", 0),
        (5, " \n\t\n ", "en", "s", 5),
        (None, body, "en", "s", 100),
        (None, None, None, None, None),
        (6, "word " * long, "en", "s", 5 * long),
        (6, "other text under the same id entirely", "en", "s", 37),
        (7, "日本語のテキスト、émigré naïve ￿ \U0001f600 x", "en", "s", 30),
        (8, "!!! ??? ...", "en", "s", 11),
    ]
