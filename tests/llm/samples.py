"""Small tables with everything that may go wrong."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `count` long, `row` string, `a.b` string"


def odd_texts() -> list[str | None]:
    return [
        None,
        "",
        " \n\t ",
        "one",
        "Two words",
        "two  WORDS\n",
        "a b c d e f g h",
        "a b c d e f g h",
        "naïve café — 😀 1²",
        "x" * 5000,
        " ".join(f"word{i % 97}" for i in range(20_000)),
        "the cat is a very quick animal of the house and the garden",
    ]


def odd_docs(spark: SparkSession) -> DataFrame:
    """NULLs in every column, empty and very long texts, repeated rows and ids, names that operators use inside."""
    rows = [
        (i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), i, "r", "d")
        for i, t in enumerate(odd_texts())
    ]
    rows += [rows[6], rows[6], (3, "another text with the same id", "en", "s0", 29, None, None, None)]
    rows += [(None, "a row without an id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def plain_docs(spark: SparkSession, texts: list[str | None], first: int = 0, sources: list[str | None] | None = None) -> DataFrame:
    rows = [
        (first + i, t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t), 0, "", "")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
