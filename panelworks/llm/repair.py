"""Token-id files compressed by Re-Pair grammars, with random access.

Ids are written in ascending key order. A shard is a run of documents of about SHARD_IDS ids
(a larger document is a shard alone) and one row of the files: its grammar's rules, which
stand for frequent pairs of symbols, the number of ids that every rule expands to, the symbol
sequence, and where each document begins in it. Rules never cross a document's end.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import ragged, scratch_path, ship_package, slices
from panelworks.llm.tokens import tokenizer

#: Shard layout: magic, first id after the terminals, documents, ids, rules, symbols, bits of a symbol, CRC-32 of the rest.
HEAD = struct.Struct("<4sIIQIQB3xI")
MAGIC = b"RPG2"

#: Ids of a shard, about: what one grammar is made for, and what a task holds at once.
SHARD_IDS = 1 << 22
#: Uses from which a rule shortens the file: each saves a symbol, and the rule takes three (two and its length).
LEAST = 4
#: Pairs are first counted in 2 ** BINS bins; the least count wanted falls by 2 ** SPREAD from round to round.
BINS, SPREAD = 20, 4


def _frequent(key: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs among ``key`` that occur ``bar`` times or more, in order, and how often."""
    pairs = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(pairs)))
    often = n >= bar
    return pairs[first[often]], n[often]


def _places(key: np.ndarray, pair: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The level of the pair that each key is, or -1 (by hash tables, as binary search costs more)."""
    bits = max(8, (4 * len(pair)).bit_length())
    out = np.full(len(key), -1, np.int32)
    odd, todo = 0x9E3779B97F4A7C15, np.arange(len(pair))
    while len(todo):  # pairs that share a slot with another one wait for the next table
        slot = lambda x: (x * np.uint64(odd) >> np.uint64(64 - bits)).view(np.int64)  # noqa: B023, E731
        table = np.full(1 << bits, -1, np.int64)
        at = slot(pair[todo])
        table[at] = todo
        found = table[slot(key)]
        out = np.where((found >= 0) & (pair[found] == key), level[found], out)
        todo = todo[table[at] != todo]
        odd = odd * 0xD1342543DE82EF95 % (1 << 64) | 1
    return out


def _winners(touch: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Which of pairs in text order are replaced; ``touch``: each one's second symbol is the next one's first.

    In a run of one pair every second one stays out; of different pairs that overlap the one
    of the lowest level (the most frequent) wins.
    """
    if not len(level):
        return np.empty(0, np.bool_)
    same = np.concatenate([[False], touch & (level[1:] == level[:-1])])
    index = np.arange(len(level), dtype=np.int32)
    odd = ((index - np.maximum.accumulate(np.where(same, 0, index))) & 1).astype(np.bool_)
    # One that stays out beats nobody; its neighbours do not touch each other.
    lower = np.where(odd, np.iinfo(level.dtype).max, level)
    out = ~odd
    out[1:] &= ~(touch & (lower[:-1] < level[1:]))
    out[:-1] &= ~(touch & (lower[1:] < level[:-1]))
    return out


class _Rules:
    """Rules in the order they are made, and the symbol of each pair that is one."""

    def __init__(self, terminals: int):
        self.terminals, self.pairs, self.symbol = terminals, [], {}

    def choose(self, key: np.ndarray, bar: int, touching, patient: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places that are replaced, their new symbols, places of frequent pairs that are not) of the pairs ``key``.

        ``touching(places)`` says which of them overlap the next one. Rules are made for pairs
        that occur ``bar`` times and win LEAST times or more; pairs that are rules already
        are replaced anywhere. ``patient``: while nothing wins, the best pair that wins too
        few times stands back for the others.
        """
        pair, n = _frequent(key, bar)
        if not len(pair):
            return (np.empty(0, np.int64),) * 3
        order = np.lexsort((pair, -n))
        rank = np.empty(len(pair), np.int32)
        rank[order] = np.arange(len(pair))
        level = _places(key, pair, rank)
        hit = np.flatnonzero(level >= 0)
        level = level[hit]
        win = _winners(touching(hit), level)
        used = np.bincount(level[win], minlength=len(pair))
        every = hit
        while patient and len(hit) and used.max() < LEAST:
            hit, level = hit[level > level.min()], level[level > level.min()]
            win = _winners(touching(hit), level)
            used = np.bincount(level[win], minlength=len(pair))
        number = np.full(len(pair), -1, np.int64)
        some = np.flatnonzero(used)
        for r, p, u in zip(some.tolist(), pair[order[some]].tolist(), used[some].tolist(), strict=True):
            own = self.symbol.get(p, -1)
            if own < 0 and u >= LEAST:
                own = self.symbol[p] = self.terminals + len(self.pairs)
                self.pairs.append(p)
            number[r] = own
        new = number[level]
        win &= new >= 0
        return hit[win], new[win], every if patient else hit[~win]


def compress(ids: np.ndarray, doc: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document of each symbol, rules) for ids below ``terminals``.

    Each round takes the pairs that occur as often as a bar asks, the most frequent first, as
    rules and replaces them from left to right; symbol ``terminals + r`` stands for rule r.
    The bar falls to LEAST. From then on only pairs beside a symbol made in the last round
    can have become frequent (all occurrences of a new symbol are there), so only these are
    counted, until no pair would shorten the file as a rule.
    """
    s = ids.astype(np.uint32)
    last = np.append(doc[1:] != doc[:-1], True) if len(s) else np.empty(0, np.bool_)
    made, bar = _Rules(terminals), len(s)
    pairs_of = lambda a, b: (a.astype(np.uint64) << np.uint64(32)) | b
    odd = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
    while len(s) > 1:
        # A pair is no more frequent than its bin: pairs in small bins need no exact count.
        slot = (s[:-1] * odd[0] + s[1:] * odd[1]) >> np.uint32(32 - BINS)
        count = np.bincount(slot, minlength=1 << BINS)
        bar = max(LEAST, min(bar, int(count.max())) >> SPREAD)
        busy = (count >= bar)[slot]
        busy &= ~last[:-1]
        at = np.flatnonzero(busy)
        won, new, lost = made.choose(pairs_of(s[at], s[at + 1]), bar, lambda hit: np.diff(at[hit]) == 1)  # noqa: B023
        won, lost = at[won], at[lost]
        s[won] = new
        last[won] = last[won + 1]
        if bar == LEAST:
            break
        stay = np.ones(len(s), np.bool_)
        stay[won + 1] = False
        s, last = s[stay], last[stay]
    if len(s) > 1 and len(won):
        s, last = _finish(s, last, won, lost, made, pairs_of)
    rules = np.array(made.pairs, np.uint64)
    rules = np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)
    return s.astype(np.int64), np.cumsum(last) - last, rules


def _finish(s, last, won, lost, made, pairs_of):
    """Rounds at the bar LEAST on symbols in a linked list, so that each costs what it changes."""
    end = len(s)
    after, before = np.arange(1, end + 1, dtype=np.int32), np.arange(-1, end - 1, dtype=np.int32)
    gone = np.zeros(end, np.bool_)

    def drop(places: np.ndarray) -> None:
        second = after[places]
        gone[second] = True
        third = after[second]
        after[places] = third
        before[third[third < end]] = places[third < end]

    drop(won)
    while len(won):
        left = before[won]
        at = np.sort(np.concatenate([won.astype(np.int32), left[left >= 0], lost[~gone[lost]].astype(np.int32)]))
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        at = at[~last[at]]
        key, touching = pairs_of(s[at], s[after[at]]), lambda hit: after[at[hit[:-1]]] == at[hit[1:]]  # noqa: B023, E731
        won, new, lost = made.choose(key, LEAST, touching)
        if not len(won):
            won, new, lost = made.choose(key, LEAST, touching, patient=True)
        won, lost = at[won], at[lost]
        s[won] = new
        last[won] = last[after[won]]
        drop(won)
    return s[~gone], last[~gone]


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that every rule stands for."""
    length = np.ones(terminals + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        length[terminals + r] = length[a] + length[b]
    return length[terminals:]


def _to_planes(symbols: np.ndarray, bits: int) -> bytes:
    """Numbers as their lower 16 bits and then a bit plane for every further one."""
    return symbols.astype("<u2").tobytes() + b"".join(np.packbits((symbols >> b & 1).astype(np.bool_)).tobytes() for b in range(16, bits))


def to_bytes(ids: np.ndarray, counts: np.ndarray, terminals: int) -> bytes:
    """A shard of documents: ``counts[i]`` ids of each, one after another."""
    s, d, rules = compress(ids, np.repeat(np.arange(len(counts)), counts), terminals)
    bits = max(16, int(terminals + len(rules)).bit_length())
    symbols = np.zeros(len(counts), np.int64)
    symbols[np.flatnonzero(counts)] = np.bincount(d, minlength=int((counts > 0).sum()))
    body = _to_planes(np.concatenate([rules.ravel(), s]), bits) + b"".join(x.tobytes() for x in (expansion_lengths(rules, terminals).astype("<u4"), np.asarray(counts).astype("<u8"), symbols.astype("<u8")))
    return HEAD.pack(MAGIC, terminals, len(counts), len(ids), len(rules), len(s), bits, zlib.crc32(body)) + body


class Shard:
    """A shard read from bytes; documents and ranges of ids are decoded without the rest. Damaged bytes raise."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size or data[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        _, self.terminals, docs, self.n_ids, n_rules, n_symbols, bits, crc = HEAD.unpack_from(data)
        if zlib.crc32(memoryview(data)[HEAD.size :]) != crc:
            raise ValueError("a damaged shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out.astype(np.int64)

        n = 2 * n_rules + n_symbols
        both = take("<u2", n)
        for b in range(16, bits):
            both |= np.unpackbits(take("u1", -(-n // 8)).astype(np.uint8), count=n).astype(np.int64) << b
        self.rules, self.symbols = both[: 2 * n_rules].reshape(-1, 2), both[2 * n_rules :]
        self.lengths = take("<u4", n_rules)
        self.counts, self.symbol_counts = take("<u8", docs), take("<u8", docs)
        self._table()

    def _table(self) -> None:
        """The ids of all rules, flat: a rule is its left symbol's ids and then its right one's."""
        t = self.terminals
        self.length = np.concatenate([np.ones(t, np.int64), self.lengths])
        ends = np.cumsum(self.length)
        self.start = ends - self.length
        self.flat = np.empty(int(ends[-1]), np.int64)
        self.flat[:t] = np.arange(t)
        depth = np.zeros(len(self.length), np.int32)
        for r, (a, b) in enumerate(self.rules.tolist()):
            depth[t + r] = 1 + max(depth[a], depth[b])
        for level in range(1, int(depth.max()) + 1 if len(depth) else 1):
            r = np.flatnonzero(depth == level)
            for side, shift in ((0, 0), (1, 1)):
                part = self.rules[r - t, side]
                to = self.start[r] + (self.length[self.rules[r - t, 0]] if shift else 0)
                self.flat[ragged(to, self.length[part])] = self.flat[ragged(self.start[part], self.length[part])]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[symbols], self.length[symbols])] if len(symbols) else np.empty(0, np.int64)

    def all(self) -> np.ndarray:
        """The ids of all documents."""
        return self._expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document."""
        end = int(self.symbol_counts[: i + 1].sum())
        return self._expand(self.symbols[end - int(self.symbol_counts[i]) : end])

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive) of the shard, expanding only the symbols they lie in."""
        if not 0 <= start <= end <= self.n_ids:
            raise IndexError("outside the shard")
        bound = np.concatenate([[0], np.cumsum(self.length[self.symbols])])
        first, last = int(np.searchsorted(bound, start, "right")) - 1, int(np.searchsorted(bound, end, "left"))
        return self._expand(self.symbols[first:last])[start - int(bound[first]) :][: end - start] if end > start else np.empty(0, np.int64)


def write(docs: DataFrame, path: str, tokenizer_path: str, *, end: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end`` and write the ids to ``path`` in ascending key order.

    The files are Parquet: part (number of the key range), shard (number in it), start (ids
    before the shard in its part), n_tokens, the documents' keys, and the shard's bytes. Null
    text is empty, null keys come first; equal keys are ordered by their text's CRC-32 and
    then the text. An empty table gives no shard.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        own = tokenizer(tokenizer_path)
        terminals = own.library.get_vocab_size()
        part, number, start = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def shard():
            keys = pa.concat_arrays([k for k, _, _ in held])
            ids, counts = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            held.clear()
            keys = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), keys)
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), keys, pa.array([to_bytes(ids, counts, terminals)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "start", "n_tokens", "keys", "data"])

        for piece, texts in slices(batches, "text_"):
            ids, counts = own.encode_with_end(texts, end)
            if held and size + len(ids) > SHARD_IDS:
                yield shard()
                number, start, size = number + 1, start + size, 0
            held.append((piece.column(0), ids, counts))
            size += len(ids)
        if held:
            yield shard()

    rows = docs.selectExpr(f"`{key}` AS key_", f"CAST(`{text}` AS STRING) AS text_")
    crc = F.crc32(F.encode(F.coalesce("text_", F.lit("")), "UTF-8"))
    ordered = rows.withColumn("crc_", crc).repartitionByRange("key_", "crc_").sortWithinPartitions("key_", "crc_", "text_").select("key_", "text_")
    shards = ordered.mapInArrow(run, f"part int, shard int, start long, n_tokens long, keys array<{kind}>, data binary")
    shards.write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, *, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in files of :func:`write`.

    ``start`` is the number of ids of all documents before. Only one total for each part
    comes to the driver (as many as the write had tasks). Null and repeated keys come back
    as they were written; files without shards give an empty result; a damaged shard raises.
    """
    ship_package(spark)
    shards = spark.read.parquet(path)
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column(4)[i].as_py())
                ids = shard.all()
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(shard.counts)
                start = ends - shard.counts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist())]
                first = before[batch.column(0)[i].as_py()] + batch.column(2)[i].as_py()
                out = [batch.column(3)[i].values, pa.array(start + first), pa.array(shard.counts), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(start, ends[-1:]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["key_", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    rows = shards.select("part", "shard", "start", "keys", "data")
    return rows.mapInArrow(run, f"key_ {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")).withColumnRenamed("key_", key)


def write_and_read(docs: DataFrame, tokenizer_path: str, *, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to a new folder in the shared scratch space and read it back.

    Null texts are empty and have the end id alone. Null keys come first, repeated keys and
    rows are documents of their own, side by side; other columns are ignored; an empty table
    gives an empty result.
    """
    path = scratch_path(docs.sparkSession, "ids")
    write(docs, path, tokenizer_path, end=end, key=key, text=text)
    return read(docs.sparkSession, path, key=key)
