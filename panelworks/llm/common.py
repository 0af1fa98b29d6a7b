"""Helpers shared by the text operators: scratch tables, bounded slices, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from panelworks.session import materialise, scratch_path  # noqa: F401  (operators take them from here)

#: Text handled at once inside a Python worker; longer single texts form a slice alone.
#: Operators that hold many numbers for each word take less.
SLICE_BYTES, SMALL_SLICE = 4 << 20, 2 << 20

_WORD_SPACE = bytes(range(9, 14))
_TO_SPACE = bytes.maketrans(_WORD_SPACE, b" " * len(_WORD_SPACE))
_UPPER = bytes(range(65, 91))
_TO_SPACE_LOWER = bytes.maketrans(_WORD_SPACE + _UPPER, b" " * len(_WORD_SPACE) + _UPPER.lower())


def ship_package(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def text_digest(text: str = "text"):
    """(size, text_crc32): UTF-8 bytes plus 1, and the unsigned CRC-32 of the bytes; null is empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (F.octet_length(whole) + 1).cast("long"), F.crc32(F.encode(whole, "UTF-8")).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches so that each piece holds about ``max_bytes`` of ``column``.

    Yields the piece and its text column with nulls replaced by empty strings.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = pc.fill_null(text, "")
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        start = 0
        while start < len(size):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + max_bytes, "right")))
            yield batch.slice(start, end - start), text.slice(start, end - start)
            start = end
        del batch, text
        give_back()


def merged(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined to larger ones of about ``least_bytes``."""
    held, size = [], 0
    for batch in itertools.chain(batches, (None,)):
        if batch is not None:
            held.append(batch)
            size += batch.nbytes
        if held and (batch is None or size >= least_bytes):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a null-free string array, the offsets starting at 0."""
    if text.type != pa.large_string():
        text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text) or text.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of an array of texts, as flat arrays.

    data, starts, ends: bytes (lower-cased A-Z if asked) and each word's range in them;
    doc: the text's index of each word; counts: words of each text.
    """

    def __init__(self, text: pa.Array, lower: bool, table: bytes | None = None):
        raw, offsets = utf8_buffer(text)
        self.data = np.frombuffer(raw.tobytes().translate(table or (_TO_SPACE_LOWER if lower else _TO_SPACE)), np.uint8)
        self.offsets = offsets
        solid = np.zeros(len(self.data) + 1, np.bool_)
        np.not_equal(self.data, 32, out=solid[:-1])
        first = np.zeros(len(self.data) + 1, np.bool_)
        first[offsets] = True
        before = np.zeros(len(self.data) + 1, np.bool_)
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | first))
        self.ends = np.flatnonzero(before & (~solid | first))
        self.counts = np.diff(np.searchsorted(self.starts, offsets))
        self.doc = np.repeat(np.arange(len(text)), self.counts)
        self.solid = solid[:-1]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def lengths(self) -> np.ndarray:
        return self.ends - self.starts

    def array(self) -> pa.Array:
        """The words as an Arrow array."""
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.lengths, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.solid])])

    def hashes(self, first_bytes: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word (or of its first bytes), the same in every process."""
        if not len(self):
            return np.empty(0, np.uint64)
        lengths = self.lengths
        if first_bytes:
            lengths = np.minimum(lengths, first_bytes)
            packed = self.data[ragged(self.starts, lengths)].astype(np.uint64)
        else:
            packed = self.data[self.solid].astype(np.uint64)
        packed += np.uint64(1)
        first = np.cumsum(lengths) - lengths
        position = np.arange(len(packed)) - np.repeat(first, lengths)
        packed *= multipliers(int(lengths.max()))[position]
        return mix(np.add.reduceat(packed, first))


_ODD = np.empty(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    """The first n of a fixed sequence of odd 64-bit multipliers."""
    global _ODD
    if len(_ODD) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _ODD = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _ODD


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them) for every i, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes (len(h) - n + 1 of them), by position-weighted sums."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    odd = multipliers(64 + n)
    size = len(h) - n + 1
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += h[j : j + size] * odd[32 + j]
    return mix(total)


class WordCache:
    """Ids of words that this process has encoded, at most ``limit`` words.

    The words are an Arrow array that is searched as a whole; once it is full new words are
    encoded each time they come, and when most are new it starts over with those.
    """

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = np.empty(0, np.int32)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def get(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): where the ids of each of the different words lie; ``encode`` gives (ids, lengths) of unknown ones."""
        kind, words = words.type, words.cast(pa.large_string())
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(at < 0)
        if not len(unknown):
            return self.ids, self.starts[at], self.lengths[at]
        if len(self.words) and len(self.words) + len(unknown) > self.limit and 2 * len(unknown) > len(words):
            self._clear()
            unknown = np.arange(len(words))
        new = words.take(pa.array(unknown))
        ids, lengths = encode(new.cast(kind))
        all_ids = np.concatenate([self.ids, ids.astype(np.int32)])
        all_starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        all_lengths = np.concatenate([self.lengths, lengths])
        at[unknown] = np.arange(len(self.starts), len(all_starts))
        room = min(len(new), self.limit - len(self.words))
        if room > 0:
            self.words = pa.concat_arrays([self.words, new.slice(0, room)])
            kept = len(self.words)
            self.starts, self.lengths = all_starts[:kept].copy(), all_lengths[:kept].copy()
            self.ids = all_ids[: int(self.starts[-1] + self.lengths[-1])].copy()
        return all_ids, all_starts[at], all_lengths[at]
