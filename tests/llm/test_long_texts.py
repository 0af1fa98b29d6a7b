"""A text of 10 MB, longer than any slice, through the operators that read texts in slices."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from panelworks.llm import infill, ogg, repetition, sharding, spm
from panelworks.llm.queries import vocabulary_file

LONG = "".join(f"wörd{i % 9973} goes on, line {i % 31}\n" for i in range(420_000))


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, LONG), (2, "short one")], "doc_id long, text string").cache()


def one(df):
    return {r["doc_id"]: r for r in df.collect()}[1]


def test_a_long_text_in_every_operator(pair):
    raw = LONG.encode()
    assert len(raw) > 10_000_000
    assert one(sharding.assign(pair))["size"] == len(raw) + 1
    assert one(repetition.assess(pair))["n_words"] == len(LONG.split())
    media = one(ogg.decode(ogg.encode(pair)))
    padded = raw + b"\0" * (-len(raw) % 64)
    assert (media["payload_sha256"], media["tail_crc32"]) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    restored = infill.restore(infill.transform(pair))
    assert one(restored)["restored"] == LONG
    got = one(spm.round_trip(pair, vocabulary_file("piece_bpe_32k.model")))
    assert got["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
