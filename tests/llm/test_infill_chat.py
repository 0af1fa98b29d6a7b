"""Infilling and chat formatting against plain re-computation."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import chat, infill


def cut(key, text):
    """(n, form, prefix_chars, middle_chars, output) by the rule, over code points."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_infill(docs, rows):
    got = sorted((tuple(r) for r in infill.restore(infill.transform(docs)).collect()), key=repr)
    assert got == sorted(((k, *cut(k, t), t or "") for k, t in rows), key=repr)


def test_infill_of_awkward_texts(spark):
    r = random.Random(3)
    alphabet = ["<", "P", "S", "M", ">", "a", "Z", "é", "日", "😀", " ", "\n", "<P", "S>", "@", "[", "`", "{", "\x00"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(12)))) for i in range(3000)] + [(5000, "word é " * 800_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = infill.restore(infill.transform(df)).collect()
    texts = dict(rows)
    assert len(out) == len(rows) and {r["form"] for r in out} == {"plain", "psm", "spm"}
    for row in out:
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == cut(row["doc_id"], texts[row["doc_id"]])
        assert row["restored"] == texts[row["doc_id"]]


@pytest.mark.parametrize("sentinels", [("<P>", "<S>", "<M>"), ("<|pre|>", "<|suf|>", "<|mid|>"), ("▁", "aab", "ab")])
def test_automaton_equals_a_walk(sentinels):
    tables = infill.ByteAutomaton(sentinels)
    r = random.Random(5)
    parts = [*sentinels, *(s[:k] for s in sentinels for k in range(1, len(s))), "a", "b", "é", "▂", "日", "-", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(200)]
    data = b"".join(b"\xff" + t.encode() for t in texts)
    state, walked = 0, []
    for b in data:
        walked.append(tables.emits[state][tables.classes[b]])
        state = tables.step[state][tables.classes[b]]
    got = tables.scan(np.frombuffer(data, np.uint8))
    assert got.tolist() == walked
    assert int((got & infill.CHARACTER > 0).sum()) == sum(map(len, texts))
    assert int((got & infill.UNIT > 0).sum()) == sum(len(re.findall("[A-Za-z]+|[^A-Za-z]", t)) for t in texts)
    assert (int((got & infill.SENTINEL > 0).sum()) > 0) == any(s in t for s in sentinels for t in texts)


def test_infill_of_no_rows(no_docs):
    assert infill.restore(infill.transform(no_docs)).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "### User: hi"), (1, 2, "assistant", "a </turn> b\n</turn>\n### Assistant: c"),
    (2, 1, "assistant", "second \\"), (2, 0, "user", "\\\\### x \\</turn>"), (2, 2, "assistant", "#### \\\\\\#### ### ### </turn></turn>"),
    (3, 0, None, None), (3, 0, "tool: ### ", "x\n"), (3, 0, "tool: ### ", "x\n"), (3, None, "User", ""), (3, 5, "assistant", None),
    (None, 0, "user", "null key ü😀"), (None, 1, "assistant", "### </turn"), (4, 0, "assistant", "##"), (4, 1, "assistant", "# x"), (5, 0, "", "\\" * 30_000 + "### "),
]


def test_chat(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn int, role string, text string, head string, at int").repartition(3)
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    texts = {r["conv_id"]: r for r in formatted.collect()}
    for conv in {t[0] for t in TURNS}:
        turns = sorted(((-1 if t[1] is None else t[1]), t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole = texts[conv]["formatted"]
        assert row["formatted_chars"] == len(whole)
        # A plain parser in Python reads the same turns; under the mask lie the assistants' texts.
        read = [p.split(": ", 1)[1] for p in whole.split("\n</turn>\n")[:-1]]
        plain = [re.sub(r"(?<!\\)\\(\\*(?:### |</turn>))", r"\1", b) for b in read]
        assert plain == [t for _, _, t in turns]
        assert [whole[s["start"] : s["start"] + s["size"]] for s in texts[conv]["spans"]] == read
    assert texts[4]["formatted"] == "### Assistant: ##\n</turn>\n### Assistant: # x\n</turn>\n"


@pytest.mark.parametrize("damage", ["concat(formatted, 'x')", "replace(formatted, 'second', 'third!')", "replace(formatted, 'Assistant', 'System')", "replace(formatted, '### ', '## ')", "substr(formatted, 2)"])
def test_chat_damage_raises(spark, damage):
    df = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string")
    bad = chat.format_conversations(df).where("conv_id = 2").withColumn("formatted", F.expr(damage))
    with pytest.raises(Exception, match="does not read back"):
        chat.read_back(bad).collect()


def test_chat_of_no_rows_and_probe(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).count() == 0
    one = chat.format_conversations(chat.with_probe(none)).first()
    assert one["conv_id"] == -7
    assert one["formatted"] == "".join(f"### {r}: \\\\### Assistant: \\</turn> ok\n</turn>\n" for r in ("User", "Assistant"))
