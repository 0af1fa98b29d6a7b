from __future__ import annotations

import random

import pytest

VOCABULARY = "the of and to in is der une la ésta größe straße thére wörd alpha beta gamma delta".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + ("." if r.random() < 0.1 else "") for _ in range(n))


#: Nulls, empty and odd texts, copies, near copies, a long text, repeated rows, null keys.
ROWS = [
    (1, prose(1, 120)), (2, prose(1, 120)), (3, prose(1, 119) + " changed"), (4, prose(2, 80)), (5, None), (6, ""), (7, "   \n\t "),
    (8, "one two"), (9, "One  TWO"), (10, "x" * 5000), (11, "日本語 😀 é  \x00 ▁ <0x0A>\r\n\x0b end"), (12, prose(3, 9000)), (12, prose(3, 9000)),
    (13, prose(4, 60)), (13, prose(5, 60)), (None, prose(6, 70)), (None, None), (14, "a b c d e\n" * 40), (15, prose(7, 200) + "\n" + "#$%&|<>* " * 9), (16, "<|endoftext|> don't I'LL  "), (17, "\u2028x\x85y\xa0z"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows, with further columns whose names operators use inside."""
    rows = [(k, t, "en", i, "c", i * 2) for i, (k, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int, key_ string, n long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def rows():
    return ROWS
