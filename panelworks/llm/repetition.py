"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelworks.llm.common import SMALL_SLICE, Words, mix, multipliers, ship_package, slices, utf8_buffer, window_hashes

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the repetition rules; a text fails if it is above any of them.

    coverage: n-gram length in words -> most share of the word characters that may lie in
    n-grams seen before in the text. line_share: the same for repeated lines.
    """

    coverage: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.18), (8, 0.15), (10, 0.12))
    line_share: float = 0.30
    min_words: int = 50
    max_repeat_percent: int = 50


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, occurs earlier) of every element."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again, early = np.zeros(len(key), np.bool_), np.zeros(len(key), np.bool_)
    later = order[1:][same]
    early[later] = True
    again[later] = True
    again[order[:-1][same]] = True
    return again, early


def _covered(flag: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a flagged window of n words."""
    edge = np.zeros(size + n + 1, np.int32)
    edge[: len(flag)] += flag
    edge[n : n + len(flag)] -= flag
    return np.cumsum(edge[:size]) > 0


def measure(text: pa.Array, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """Repetition measures of every text of a null-free string array."""
    n = len(text)
    words = Words(text, lower=False)
    code = words.array().dictionary_encode()
    chars = pc.utf8_length(code.dictionary).to_numpy(zero_copy_only=False)[code.indices.to_numpy()].astype(np.int64) if len(words) else np.empty(0, np.int64)
    spread = mix(np.arange(1, len(code.dictionary) + 1, dtype=np.uint64) * multipliers(1)[0])
    h = spread[code.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    doc = words.doc
    per = lambda x: np.bincount(doc, weights=x, minlength=n).astype(np.int64)
    salt = mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * multipliers(2)[1])

    def windows(k: int) -> tuple[np.ndarray, np.ndarray]:
        w = window_hashes(h, k)
        inside = doc[: len(w)] == doc[k - 1 : k - 1 + len(w)] if len(w) else np.empty(0, np.bool_)
        again, early = np.zeros(len(w), np.bool_), np.zeros(len(w), np.bool_)
        at = np.flatnonzero(inside)
        again[at], early[at] = _repeats(w[at] + salt[doc[at]])
        return again, early

    out = {"n_words": words.counts.astype(np.int64), "word_chars": per(chars)}
    raw, offsets = utf8_buffer(text)
    is_symbol = np.zeros(256, np.bool_)
    is_symbol[list(SYMBOLS.encode())] = True
    total = np.concatenate([[0], np.cumsum(is_symbol[raw])])
    out["n_symbols"] = (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)

    lines = pc.split_pattern(text, "\n")
    line_doc = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    line = lines.flatten().dictionary_encode()
    index = line.indices.to_numpy()
    has_word = pc.utf8_length(pc.utf8_trim(line.dictionary, " \t\n\v\f\r")).to_numpy(zero_copy_only=False) > 0
    kept = np.flatnonzero(has_word[index]) if len(index) else np.empty(0, np.int64)
    _, early = _repeats(line_doc[kept].astype(np.int64) * max(1, len(line.dictionary)) + index[kept])
    dup_doc = line_doc[kept][early]
    out["n_dup_lines"] = np.bincount(dup_doc, minlength=n).astype(np.int64)
    size = pc.utf8_length(pc.replace_substring_regex(line.dictionary, "[\\x20\\x09-\\x0D]+", "")).to_numpy(zero_copy_only=False)
    dup_chars = np.bincount(dup_doc, weights=size[index[kept][early]] if len(kept) else None, minlength=n)

    again, _ = windows(3)
    out["n_repeat_words"] = per(_covered(again, 3, len(h)))
    base = np.maximum(out["word_chars"], 1)
    out["line_share"] = dup_chars / base
    for k, _limit in rules.coverage:
        _, early = windows(k)
        out[f"coverage_{k}"] = per(chars * _covered(early, k, len(h))) / base
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    worst = out["line_share"] > rules.line_share
    for k, limit in rules.coverage:
        worst |= out[f"coverage_{k}"] > limit
    out["kept"] = ~out["base_failed"] & ~worst
    return out


def columns(rules: Rules = Rules()) -> list[tuple[str, pa.DataType, str]]:
    longs = [(c, pa.int64(), "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    shares = [(c, pa.float64(), "double") for c in ("line_share", *(f"coverage_{k}" for k, _ in rules.coverage))]
    return [*longs, *shares, ("base_failed", pa.bool_(), "boolean"), ("kept", pa.bool_(), "boolean")]


def assess(docs: DataFrame, rules: Rules = Rules(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, measures, ``base_failed`` and ``kept`` of every document.

    Words are runs of other characters than space and \\x09-\\x0D. ``coverage_n`` is the share
    of word characters inside word n-grams that occurred earlier in the same text,
    ``line_share`` the share in lines equal to an earlier one. Null and empty texts have no
    words and fail. Repeated rows each get a row, a null key stays null, further columns are
    ignored, an empty table gives an empty result. Texts are measured whole.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    wanted = columns(rules)

    def run(batches):
        for piece, texts in slices(batches, "text_", SMALL_SLICE):
            found = measure(texts, rules)
            yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(found[c], t) for c, t, _ in wanted]], ["key_", *[c for c, _, _ in wanted]])

    rows = docs.selectExpr(f"`{key}` AS key_", f"CAST(`{text}` AS STRING) AS text_")
    return rows.mapInArrow(run, ", ".join([f"key_ {kind}", *[f"{c} {s}" for c, _, s in wanted]])).withColumnRenamed("key_", key)


def keep(docs: DataFrame, rules: Rules = Rules(), *, text: str = "text") -> DataFrame:
    """The documents that pass the rules, with all their columns (texts are judged where they stand).

    Null and empty texts have no words and do not pass. Each row is judged by itself, so null
    and repeated keys and rows change nothing; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for piece, texts in slices(batches, docs_names[at], SMALL_SLICE):
            yield piece.filter(pa.array(measure(texts, rules)["kept"]))

    docs_names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*docs_names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


