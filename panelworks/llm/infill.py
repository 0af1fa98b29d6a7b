"""Fill-in-the-middle reordering, cut at unit boundaries that a byte automaton finds.

The automaton reads UTF-8 bytes and knows three things at once: whether a byte goes on with a
character, whether it goes on with a run of letters, and how much of a sentinel has been
read. Its transitions carry counts: a unit begins, a character begins, a sentinel ends. Its
state depends on the last few bytes only (as many as the longest sentinel has), so all
positions of a slice are worked at once, one table lookup for each of these bytes. A second
pass turns the wanted unit numbers into byte positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import ship_package, slices

#: The marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Never a byte of UTF-8; stands before every text of a slice.
_EDGE = 0xFF
UNIT, CHARACTER, SENTINEL = 1, 2, 4


class ByteAutomaton:
    """Transition and emission tables over byte classes, built from the sentinels.

    classes: class of each byte. step[state, class]: the next state. emits[state, class]: the
    sum of UNIT, CHARACTER and SENTINEL that this transition counts. memory: after so many
    bytes the state no longer depends on where the automaton began.
    """

    def __init__(self, sentinels: Sequence[str]):
        marks = [s.encode() for s in sentinels]
        if not all(marks) or len(set(marks)) != len(marks):
            raise ValueError("sentinels must be different and not empty")
        own = {b for m in marks for b in m}
        kinds: dict[tuple, int] = {}
        examples: list[int] = []
        self.classes = np.empty(256, np.uint8)
        for b in range(256):
            kind = (self._kind(b), b if b in own else None)
            if kind not in kinds:
                kinds[kind] = len(kinds)
                examples.append(b)
            self.classes[b] = kinds[kind]
        # A state: how much of a sentinel the last bytes are, and whether the last one is a letter.
        begun = {m[:i] for m in marks for i in range(len(m) + 1)}
        states, rows, emits = {(b"", False): 0}, [], []
        for read, word in iter(todo := [(b"", False)]):
            row, out = [], []
            for b in examples:
                kind = self._kind(b)
                if kind == "edge":
                    after, counts = (b"", False), 0
                else:
                    seen = read + bytes([b])
                    held = next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in begun)
                    after = (held, kind == "letter")
                    counts = (UNIT if kind in ("other", "lead") or kind == "letter" and not word else 0) | (CHARACTER if kind != "next" else 0)
                    counts |= SENTINEL if any(seen.endswith(m) for m in marks) else 0
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row.append(states[after])
                out.append(counts)
            rows.append(row)
            emits.append(out)
        if len(states) > 255:
            raise ValueError("sentinels too long for a table of bytes")
        self.step, self.emits = np.array(rows, np.uint8), np.array(emits, np.uint8)
        self.memory = max(map(len, marks))

    @staticmethod
    def _kind(b: int) -> str:
        if b == _EDGE:
            return "edge"
        if b < 0x80:
            return "letter" if chr(b).isalpha() else "other"
        return "lead" if b >= 0xC0 else "next"

    def scan(self, data: np.ndarray) -> np.ndarray:
        """What the transition at each byte counts; ``data`` begins with an edge."""
        kinds = len(self.step[0])
        row = self.classes[data]
        step, emits = (self.step.astype(np.uint16) * kinds).ravel(), self.emits.ravel()
        state = np.zeros(len(data), np.uint16)  # times the number of classes
        for back in range(self.memory, 0, -1):
            state[back:] = step[state[back:] + row[:-back]]
        return emits[state + row]


@lru_cache(maxsize=4)
def automaton(sentinels: tuple[str, ...]) -> ByteAutomaton:
    """The tables of a set of sentinels, kept for the process."""
    return ByteAutomaton(sentinels)


def draws(key: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers: the first groups of the hex SHA-256 of ``seed:key`` (null key: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): every text reordered for infilling.

    n: units ``[A-Za-z]+|[^A-Za-z]``. form: ``plain`` (the text as it is), ``psm`` or ``spm``, drawn
    from the key. Empty texts and texts that hold a sentinel are plain, and plain rows have null
    character counts. Null text is empty; null and repeated keys stay, each row being cut by its
    own key (equal rows alike); other columns are ignored, an empty table gives an empty
    result. Texts of any length are read whole, in slices of whole texts.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    before, between, last = (s.encode() for s in sentinels)

    def run(batches):
        tables = automaton(tuple(sentinels))
        for piece, texts in slices(batches, "text_"):
            raw = texts.cast(pa.large_binary()).to_pylist()
            data = np.frombuffer(b"".join(x for t in raw for x in (b"\xff", t)), np.uint8)
            length = np.fromiter(map(len, raw), np.int64, len(raw))
            end = np.cumsum(length + 1)
            begin = end - length
            counts = tables.scan(data)
            units = np.flatnonzero(counts & UNIT)
            first = np.searchsorted(units, begin)
            n = np.searchsorted(units, end) - first
            found = np.flatnonzero(counts & SENTINEL)
            marked = np.searchsorted(found, end) > np.searchsorted(found, begin)
            h = piece.column(2).flatten().to_numpy().reshape(-1, 4)
            plain = (n == 0) | marked | (h[:, 2] % 100 >= 100 - plain_percent)
            spm = ~plain & (h[:, 3] % 100 < spm_percent)
            # The second pass: where the units after the cuts begin.
            cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
            unit = np.append(units, len(data))
            at = np.where(cuts < n[:, None], unit[np.minimum(first[:, None] + cuts, len(units))], end[:, None])
            characters = np.concatenate([[0], np.cumsum((counts & CHARACTER) > 0, dtype=np.int32)])
            done = characters[np.column_stack([begin, at])]
            chars = np.diff(done, axis=1)
            a, b = (at - begin[:, None]).T.tolist()
            out = []
            for t, p, s, x, y in zip(raw, plain.tolist(), spm.tolist(), a, b):
                if p:
                    out.append(t)
                elif s:
                    out.append(b"".join((between, t[y:], before, t[:x], last, t[x:y])))
                else:
                    out.append(b"".join((before, t[:x], between, t[y:], last, t[x:y])))
            columns = [piece.column(0), pa.array(n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()), *(pa.array(chars[:, i].astype(np.int64), mask=plain) for i in (0, 1)), pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key_", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_"), draws(F.col(key), seed).alias("draws_"))
    return rows.mapInArrow(run, f"key_ {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key_", key)


def restore(formed: DataFrame, *, to: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``to``: the text that ``form`` and ``output`` came from.

    No part holds a sentinel, and no sentinel begins as it ends, so the first of each is the
    one that was written. Null outputs give null.
    """
    before, between, last = sentinels
    out, size = F.col("output"), [len(s) for s in sentinels]
    head, middle = F.substring_index(out, last, 1), F.substring_index(out, last, -1)
    psm_prefix, psm_suffix = F.substring_index(F.substr(head, F.lit(size[0] + 1)), between, 1), F.substring_index(head, between, -1)
    spm_suffix, spm_prefix = F.substring_index(F.substr(head, F.lit(size[1] + 1)), before, 1), F.substring_index(head, before, -1)
    whole = F.when(F.col("form") == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(F.col("form") == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(out)
    return formed.withColumn(to, whole)
