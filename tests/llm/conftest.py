from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, doc double, tag string, k string, c string, node string, slot int, positions string, bands string"


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = prose(400), prose(70), "This very line stands in more than three documents"
    edited = base.split(" ")
    edited[200] = "EDIT"
    texts = [
        (1, base, "a"), (2, base, "a"), (3, " ".join(edited), "b"), (4, None, "b"), (5, "", None), (6, " \n\t ", "c"),
        (7, f"{line}\n{passage}\n{prose(30)}", "a"), (8, f"  {line.upper()}  \n{prose(20)} {passage} tail", "a"), (9, f"{line}\nshort\n{line}", "c"),
        (None, f"{line}\n{prose(60)}", "b"), (None, None, None), (10, prose(120_000), "a"), (11, "x" * 300_000, "b"), (12, "one two three", "c"), (12, "one two three", "c"), (12, passage, "c"),
        (13, "Licensed under the Apache License, Version 2.0.\nnothing", "a"), (14, "gnu general public license GNU\tGeneral public-license", None), (15, "naïve ’quote’ 日本 語 <|endoftext|> \r\n12³", "é"), (2**40, prose(64), "z"),
    ]
    return [(i, t, "en", s, len(t or ""), "size", 1, 1.5, "tag", "k", "c", "node", 3, "p", "b") for i, t, s in texts]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
