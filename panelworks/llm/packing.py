"""Best-fit packing: repeat counts of few-document patterns by non-negative least squares.

The number of pieces of each length is all that packing needs, and that histogram has at
most ``limit`` entries whatever the corpus. Patterns of two to seven lengths that fill a
sequence exactly are fitted to it, the repeat counts are rounded, and the same is done with
what is left, as long as patterns take a fair part of it; the remainder is packed best-fit by
whole multiplicities. The plan so made has a bounded number of rows and is applied to all
pieces by their number within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.llm.common import materialise, ship_package, slices
from panelworks.llm.tokens import tokenizer

#: Buckets in which pieces of one length are numbered apart.
BUCKETS = 256


def pieces(docs: DataFrame, tokenizer_path: str, *, limit: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's pieces of at most ``limit`` ids.

    A document is its text's ids and then ``end``; null text is empty and gives one piece of
    one id. Only documents above the limit are cut, every ``limit`` ids.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        own = tokenizer(tokenizer_path)
        for piece, texts in slices(batches, "text_"):
            ids, counts = own.encode_with_end(texts, end)
            n = -(-counts // limit)
            row = np.repeat(np.arange(len(counts)), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = number * limit
            length = np.minimum(counts[row] - start, limit)
            data = memoryview(ids.astype("<u4").tobytes())
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist())]
            columns = [piece.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key_", "piece", "start", "length", "ids_crc32"])

    rows = docs.selectExpr(f"`{key}` AS key_", f"CAST(`{text}` AS STRING) AS text_")
    return rows.mapInArrow(run, f"key_ {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key_", key)


#: Pairs of lengths that are tried for a sum, and rounds of fitting, at most.
PAIRS, ROUNDS = 6, 12


def pairs_of(have: np.ndarray, limit: int) -> list[list[tuple[int, int]]]:
    """For every sum below ``limit`` some pairs (a >= b) of the lengths ``have``, spread over all there are."""
    there = np.zeros(limit + 1, np.bool_)
    there[have] = True
    out: list[list[tuple[int, int]]] = []
    for s in range(limit + 1):
        low = np.flatnonzero(there[: s // 2 + 1] & there[s - s // 2 : s + 1][::-1]) if s > 1 else np.empty(0, np.int64)
        chosen = low[np.unique(np.linspace(0, len(low) - 1, min(PAIRS, len(low))).astype(int))] if len(low) else low
        out.append([(s - b, b) for b in chosen.tolist()])
    return out


def patterns(histogram: np.ndarray, limit: int) -> list[tuple[int, ...]]:
    """Patterns of two to seven lengths (descending) that fill a sequence.

    histogram[l] is the number of pieces of length l. All pairs are there, and for every
    length, and every sum of two, patterns that hold it together with pairs whose sums are
    spread over what remains. What one round leaves can be in other patterns in the next. A
    length alone is no pattern: it would fit any histogram and fill nothing.
    """
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    pair = pairs_of(have, limit)
    found: dict[tuple[int, ...], None] = {}

    def add(*lengths: int) -> None:
        p = tuple(sorted(lengths, reverse=True))
        if all(histogram[v] >= p.count(v) for v in set(p)):
            found[p] = None

    def fill(start: tuple[int, ...], room: int, pairs: int, turn: int) -> None:
        """Fill ``room`` by so many pairs of about equal sums."""
        for k in range(3):
            left, out = room, start
            for i in range(pairs, 0, -1):
                s = left if i == 1 else max(2, left // i + (turn * 37 + k * 53) % 211 - 105)
                options = pair[s] if 1 < s <= left else []
                if not options:
                    break
                chosen = options[(turn + k + i) % len(options)]
                out, left = (*out, *chosen), left - s
            else:
                if not left:
                    add(*out)

    there = set(have.tolist())
    for a in have.tolist():
        if 2 * a >= limit and limit - a in there:
            add(a, limit - a)
        for p in pair[limit - a] if a < limit else []:
            add(a, *p)
        fill((a,), limit - a, 2, a)
        fill((a,), limit - a, 3, a)
    for s in range(2, limit // 2 + 1):
        if pair[s]:
            fill(pair[s][s % len(pair[s])], limit - s, 1, s)
            fill(pair[s][s % len(pair[s])], limit - s, 2, s)
    return list(found)


def fit(histogram: np.ndarray, chosen: list[tuple[int, ...]], sweeps: int = 16) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns, least squares of (members of x patterns - histogram).

    Weighted by 1 / sqrt(count), and solved by coordinate descent: each step sets one count
    to its best value with the others held, no less than 0.
    """
    h = histogram.astype(np.float64)
    weight = 1 / np.maximum(h, 1)
    rest = h.tolist()
    w = weight.tolist()
    rows = [[(v, p.count(v)) for v in dict.fromkeys(p)] for p in chosen]
    scale = [sum(c * c * w[v] for v, c in r) for r in rows]
    x = [0.0] * len(rows)
    for sweep in range(sweeps):
        moved = 0.0
        for i in range(len(rows) - 1, -1, -1) if sweep % 2 == 0 else range(len(rows)):
            r = rows[i]
            step = 0.0
            for v, c in r:
                step += c * w[v] * rest[v]
            step /= scale[i]
            if step < -x[i]:
                step = -x[i]
            if step:
                x[i] += step
                for v, c in r:
                    rest[v] -= c * step
                if step > moved or -step > moved:
                    moved = abs(step)
        if moved < 0.05:
            break
    return np.array(x)


def round_counts(histogram: np.ndarray, chosen: list[tuple[int, ...]], x: np.ndarray, least: float = 0.02) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that the histogram can serve, larger counts first.

    Every pattern is full, so a count that the fit sees at all is worth one sequence.
    """
    left = histogram.astype(np.int64).tolist()
    out = []
    for i in sorted(range(len(chosen)), key=lambda i: (-x[i], chosen[i])):
        if x[i] < least:
            break
        p = chosen[i]
        n = min([max(1, round(x[i])), *(left[v] // p.count(v) for v in p)])
        if n > 0:
            out.append((p, n))
            for v in p:
                left[v] -= n
    return out


def best_fit(histogram: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, how many), as (pattern, repeats).

    Open sequences of the same content are one entry with a number of repeats; placing
    lengths splits entries, so the work depends on the number of lengths and not of pieces.
    """
    open_: list[tuple[int, int]] = []  # (room, entry), ordered
    entries: list[list] = []  # [pattern, repeats]
    for v in range(limit, 0, -1):
        n = int(histogram[v])
        while n:
            at = bisect_left(open_, (v, -1))
            if at == len(open_):
                fits = limit // v
                for times, repeats in ((fits, n // fits), (n % fits, 1)):
                    if times and repeats:
                        entries.append([(v,) * times, repeats])
                        if limit > v * times:
                            insort(open_, (limit - v * times, len(entries) - 1))
                break
            room, e = open_.pop(at)
            pattern, repeats = entries[e]
            fits = min(room // v, n)
            whole = min(n // fits, repeats)
            if whole < repeats:
                entries[e][1] = repeats - whole
                insort(open_, (room, e))
                entries.append([pattern + (v,) * fits, whole])
                e = len(entries) - 1
            else:
                entries[e][0] = pattern + (v,) * fits
            n -= whole * fits
            if room - v * fits > 0:
                insort(open_, (room - v * fits, e))
    return [(tuple(p), r) for p, r in entries if r]


def fitted_patterns(histogram: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) from rounds of enumerating, fitting and rounding, until a round takes less than a hundredth."""
    h, out = histogram.astype(np.int64).copy(), []
    size = np.arange(len(h))
    for _ in range(ROUNDS):
        before = int((h * size).sum())
        chosen = patterns(h, limit)
        if not chosen:
            break
        made = round_counts(h, chosen, fit(h, chosen))
        for p, n in made:
            for v in p:
                h[v] -= n
        out += made
        if before - int((h * size).sum()) < before // 100:
            break
    return out


def plan(histogram: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold every piece of the histogram."""
    h = np.zeros(limit + 1, np.int64)
    h[: len(histogram)] = histogram
    if h[0] or (h < 0).any():
        raise ValueError("lengths lie between 1 and the limit")
    done = [((limit,), int(h[limit]))] if h[limit] else []
    h[limit] = 0
    if not h.any():
        return done
    fitted = fitted_patterns(h, limit)
    for p, n in fitted:
        for v in p:
            h[v] -= n
    return done + fitted + best_fit(h, limit)


class Plan:
    """The plan as arrays: per length, ranges of piece numbers and where each range goes."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        rows, used, first = [], {}, 0
        for pattern, repeats in made:
            offset = 0
            for v in dict.fromkeys(pattern):
                c = pattern.count(v)
                rows.append((v, used.get(v, 0), first, c, offset))
                used[v] = used.get(v, 0) + c * repeats
                offset += v * c
            first += repeats
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.sequences = first
        self.lengths, at = np.unique(self.rows[:, 0], return_index=True)
        self.at = np.append(at, len(self.rows))

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and numbers within their length."""
        if not len(length):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        big = int(max(self.rows[:, 1].max(), number.max())) + 1
        slot = np.searchsorted(self.lengths, length)
        ordered = np.repeat(np.arange(len(self.lengths)), np.diff(self.at)) * big + self.rows[:, 1]
        row = self.rows[np.searchsorted(ordered, slot * big + number, "right") - 1]
        within = number - row[:, 1]
        return row[:, 2] + within // row[:, 3], row[:, 4] + within % row[:, 3] * length


def pack(docs: DataFrame, tokenizer_path: str, *, limit: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Nulls: a null text is an empty document, a null key stays. Repeated rows and equal keys
    are packed each by itself. Other columns are ignored; an empty table gives an empty
    result. Sequences are numbered from 0 and filled from offset 0 without gaps.
    """
    return place(pieces(docs, tokenizer_path, limit=limit, end=end, key=key, text=text), limit=limit, key=key)


def place(cut: DataFrame, *, limit: int = 4096, key: str = "doc_id") -> DataFrame:
    """Give the pieces of :func:`pieces` their sequences and offsets.

    Pieces are numbered within their length in buckets apart (one length may hold a large
    share of all, and equal rows are dealt over the buckets), by a table of bucket sizes of at
    most limit x BUCKETS rows. Null keys, ties and repeated rows are pieces like any other; no
    pieces give no rows.
    """
    name = cut.columns[0]
    cut = materialise(cut.withColumn("bucket", F.pmod(F.xxhash64(F.col(name), "piece", "ids_crc32") + F.monotonically_increasing_id(), F.lit(BUCKETS)).cast("int")), "pieces")
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # One row for each length: at most ``limit`` rows come to the driver.
    counted = sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(limit + 1, np.int64)
    for r in counted:
        histogram[r["length"]] = r["n"]
    made = Plan(plan(histogram, limit))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("ids_crc32", name, "piece"))
    rows = cut.withColumn("own", own).join(offsets, ["length", "bucket"]).select(name, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("number"))
    kind = rows.schema[name].dataType.simpleString()

    def run(batches):
        for b in batches:
            sequence, offset = made.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return rows.mapInArrow(run, f"`{name}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def lower_bound(histogram: np.ndarray, limit: int) -> int:
    """Sequences that no packing can do without: tokens over limit, or pieces above half of it."""
    tokens = int((histogram * np.arange(len(histogram))).sum())
    return max(-(-tokens // limit), int(histogram[limit // 2 + 1 :].sum()))
