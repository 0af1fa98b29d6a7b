"""Alignment of two tokenizers against a plain one from the libraries' whole-text output."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelworks.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Function of (key, text) rows to the expected result, whole texts at a time."""
    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}

    def both(text):
        a = ta.encode(" " + text, add_special_tokens=False)
        b = tb.encode(text)
        ab = [bytes(byte[c] for c in t) for t in a.tokens]
        bb = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, tb.id_to_piece(i)) for i in b)]
        whole = (" " + text).encode()
        return (a.ids, b, ab, bb) if b"".join(ab) == whole and b"".join(bb) == whole else None

    def result(rows):
        cut, counts = [], Counter()
        for _, text in rows:
            found = both(text) if text else None
            groups = []
            if found:
                a, b, ab, bb = found
                i = j = x = y = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if x <= y and i < len(a):
                        x += len(ab[i])
                        ga.append(a[i])
                        i += 1
                    else:
                        y += len(bb[j])
                        gb.append(b[j])
                        j += 1
                    if x == y:
                        groups.append((ga, gb))
                        counts[ga[-1], gb[-1]] += 1
                        ga, gb = [], []
            cut.append(groups)
        best = {}
        for (_, b), c in counts.items():
            best[b] = max(best.get(b, 0), c)
        out = []
        for (key, _), groups in zip(rows, cut):
            linked = [(g[0][-1], g[1][-1]) for g in groups]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            sums = (sum(counts[p] == best[p[1]] for p in linked), sum(counts[p] for p in linked))
            out.append((key, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(groups), *sums, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return sorted(out, key=repr)

    return result


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_alignment(docs, rows, plain):
    assert collected(align.align_corpus(docs, A, B)) == plain(rows)


def test_alignment_of_awkward_texts(spark, plain, monkeypatch):
    monkeypatch.setattr(align, "BROADCAST_PAIRS", 0)
    r = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "the", "don't", "'s", "12", "é", "ñandú", "日本", "😀", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "\x00", " ", "　", "-", "_", "Ω", "é", "ﬁ"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(14)))) for i in range(1500)] + [(7777, "word é " * 100_000), (7778, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(align.align_corpus(df, A, B)) == plain(rows)


def test_alignment_of_real_documents(spark, plain):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert collected(align.align_corpus(df, A, B)) == plain([tuple(r) for r in df.collect()])


def test_alignment_of_no_rows(no_docs):
    assert align.align_corpus(no_docs, A, B).count() == 0


def test_joined_rows_are_grouped_as_they_come(docs):
    with align._by_text(docs.sparkSession, 4):
        plan = align.align(docs, A, B)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("collect_list") > 0


def test_ends_of_runs(spark):
    rows = [(i, 0, 1, ids, ids[:1]) for i, ids in enumerate([[7 * j % 50_000 for j in range(n)] for n in (1, align.RUN - 1, align.RUN, align.RUN + 1, 1000)])]
    rows = [(*r[:3], [i - (i >> 15 << 16) for i in r[3]], r[4]) for r in rows]
    texts = spark.createDataFrame(rows, "k1 long, k2 long, copies long, a array<short>, b array<short>")
    found = align._ends(texts, "a", A, F.col("copies")).where("end IS NOT NULL").collect()
    length = align.side(A).length
    for key, _, _, a, _ in rows:
        ends = np.cumsum(length[np.array(a, np.int16).view(np.uint16)]).tolist()
        assert sorted((r["end"], r["text"]) for r in found if r["k1"] == key) == [(e, 1 if e == ends[-1] else None) for e in ends]


def test_tokens_are_exploded_after_the_window(docs):
    with align._by_text(docs.sparkSession, 4):
        plan = align.align(docs, A, B)._jdf.queryExecution().executedPlan().toString()
    for branch in re.split("SortMergeJoin|BroadcastExchange", plan)[1:]:
        assert "Window" not in branch or branch.index("Generate") < branch.index("Window")
    assert plan.count("Window ") == 2 and plan.count("SortMergeJoin") == 1
