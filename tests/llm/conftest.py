from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, band string, node int, size string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), "x", "y", 1, "z")


EDGE_ROWS = [
    row(1, words(1, 60)),
    row(2, words(1, 60)),
    row(2, words(1, 60)),
    row(3, None),
    row(4, ""),
    row(5, "   \n\t "),
    row(6, words(2, 20_000)),
    row(7, "one two"),
    row(None, words(3, 40)),
    row(None, words(3, 40)),
    row(None, None, None, None),
    row(8, words(4, 50), None, None),
    row(9, words(4, 50) + " tail", "", ""),
    row(10, "ß Ünï ☃ ́ <|endoftext|> 漢字 'tis it's", "de", "b"),
]


@pytest.fixture()
def edge(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns
    with names that operators use inside."""
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
