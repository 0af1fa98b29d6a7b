"""Media columns: an Ogg container for 8-bit samples, written and read with checks.

Pages carry the Ogg CRC (polynomial 0x04C11DB7, not reflected, zero start, no final xor).
That is the bit-mirrored twin of zlib's CRC-32, so the table-driven zlib routine does the
work on bit-reversed bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelworks.llm.common import ship_package, slices

# Fixed values of the format: capture pattern, header layout, flags, page limits.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS = 255

#: Samples a second, samples in a packet, packets of a stream's turn, and streams that take turns.
RATE, PACKET, TURN, STREAMS = 8000, 4096, 4, 2
#: First packet of each stream: magic, rate, stream index, number of streams, packets of a turn, samples in a packet.
HEAD = struct.Struct("<8sIBBHI")
MAGIC = b"PCM8-raw"

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The Ogg page checksum of ``data`` (checksum field zeroed)."""
    register = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(length: int) -> bytes:
    """The segment lengths of one packet: 255s and a last one below 255."""
    return b"\xff" * (length // 255) + bytes([length % 255])


class _Page:
    """The page that a stream is filling."""

    def __init__(self, continued: bool):
        self.continued, self.granule, self.segments, self.body = continued, -1, b"", []


def mux(packets: list[tuple[int, int, bytes]]) -> bytes:
    """An Ogg file of (serial, granule position after the packet, bytes), in this order.

    A stream fills pages of up to 255 segments until another stream's packet follows, so that
    packets share pages; a packet that does not fit goes on in the stream's next page, flagged
    as continued. A stream's first packet, its header, has a page alone. A page's granule position is that of the last packet
    that ends on it, or -1 if none does. A stream's first and last page are flagged.
    """
    pages: list[tuple[int, _Page]] = []
    filling: dict[int, _Page] = {}
    before = None
    for serial, granule, data in packets:
        if before is not None and before != serial and filling[before].segments:
            pages.append((before, filling[before]))
            filling[before] = _Page(False)
        before, first = serial, serial not in filling
        page = filling.setdefault(serial, _Page(False))
        segments, at = lacing(len(data)), 0
        while at < len(segments):
            taken = segments[at : at + MAX_SEGMENTS - len(page.segments)]
            page.segments += taken
            page.body.append(data[at * 255 : at * 255 + sum(taken)])
            at += len(taken)
            done = at == len(segments)
            if done:
                page.granule = granule
            if len(page.segments) == MAX_SEGMENTS or (done and first):
                pages.append((serial, page))
                page = filling[serial] = _Page(not done)
    pages += [(serial, page) for serial, page in filling.items() if page.segments]
    number: dict[int, int] = {}
    last = {serial: i for i, (serial, _) in enumerate(pages)}
    out = []
    for i, (serial, page) in enumerate(pages):
        flags = CONTINUED * page.continued | FIRST * (serial not in number) | LAST * (last[serial] == i)
        number[serial] = number.get(serial, -1) + 1
        whole = bytearray(HEADER.pack(CAPTURE, 0, flags, page.granule, serial, number[serial], 0, len(page.segments)) + page.segments + b"".join(page.body))
        whole[22:26] = page_crc(bytes(whole)).to_bytes(4, "little")
        out.append(bytes(whole))
    return b"".join(out)


def pages_of(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, segments, body) of every page; ValueError if one is damaged."""
    at = 0
    while at < len(media):
        if len(media) < at + HEADER.size:
            raise ValueError("truncated page header")
        capture, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        body = at + HEADER.size + n
        segments = media[at + HEADER.size : body]
        end = body + sum(segments)
        if capture != CAPTURE or version or len(segments) != n or end > len(media):
            raise ValueError(f"no whole page at byte {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        yield flags, granule, serial, number, segments, media[body:end]
        at = end


def demux(media: bytes) -> dict[int, list[tuple[int, bytes]]]:
    """By logical stream, in order of appearance: its packets as (granule position, bytes).

    Packets that end on a page before its last packet get -1, as the format gives a position
    only for the last packet that a page completes; see :func:`positions`. Checks the
    checksums, the page numbers and the flags of first, last and continued pages.
    """
    streams: dict[int, list[tuple[int, bytes]]] = {}
    parts: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    for flags, granule, serial, number, segments, body in pages_of(media):
        if bool(flags & FIRST) != (serial not in streams) or serial in ended or number != expected.get(serial, 0):
            raise ValueError(f"page {number} of stream {serial} is out of order")
        packets, open_ = streams.setdefault(serial, []), parts.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(open_):
            raise ValueError(f"page {number} of stream {serial} does not continue its packet")
        expected[serial] = number + 1
        at = start = 0
        for length in segments:
            at += length
            if length < 255:
                packets.append((-1, b"".join([*open_, body[start:at]])))
                open_.clear()
                start = at
        if segments and segments[-1] == 255:
            open_.append(body[start:at])
        if granule >= 0:
            if not packets:
                raise ValueError(f"page {number} of stream {serial} has a position and no packet")
            packets[-1] = (granule, packets[-1][1])
        if flags & LAST:
            ended.add(serial)
    if ended != set(streams) or any(parts.values()):
        raise ValueError("a stream has no last page")
    return streams


def positions(packets: list[tuple[int, bytes]], duration) -> list[int]:
    """The granule position after every packet of a stream.

    Known ones are those of pages. Packets before the first known one end earlier by what
    ``duration(packet)`` says of those that follow, all others later than the one before by
    their own. A page's position has to agree with that, except that the stream's last one
    may cut its last packet short.
    """
    known = next((i for i, (granule, _) in enumerate(packets) if granule >= 0), None)
    if known is None:
        raise ValueError("a stream without granule positions")
    out = [packets[known][0]]
    for _, data in reversed(packets[1 : known + 1]):
        out.insert(0, out[0] - duration(data))
    for i, (granule, data) in enumerate(packets[known + 1 :], known + 1):
        reached = out[-1] + duration(data)
        short = i == len(packets) - 1 and out[-1] <= granule < reached
        if granule >= 0 and granule != reached and not short:
            raise ValueError("granule positions do not follow the samples")
        out.append(granule if short else reached)
    return out


def pad64(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def encode_samples(samples: bytes) -> bytes:
    """8-bit samples as Ogg: TURN packets of PACKET samples go to each logical stream in turn.

    A granule position is the number of the stream's samples up to there.
    """
    base = zlib.crc32(samples) & 0x7FFFFFFF
    serials = [base + i for i in range(STREAMS)]
    packets = [(s, 0, HEAD.pack(MAGIC, RATE, i, STREAMS, TURN, PACKET)) for i, s in enumerate(serials)]
    written = [0] * STREAMS
    for k, at in enumerate(range(0, len(samples), PACKET)):
        data, i = samples[at : at + PACKET], k // TURN % STREAMS
        written[i] += len(data)
        packets.append((serials[i], written[i], data))
    return mux(packets)


def decode_samples(media: bytes) -> tuple[bytes, dict]:
    """The samples and what the container says: streams, packets, pages, seconds, and the time at which each packet ends.

    The streams' packets are dealt in turn by the index in their headers; a packet's time in
    its stream is its granule position over the rate.
    """
    streams = demux(media)
    dealt: dict[int, list[bytes]] = {}
    times: dict[int, list[float]] = {}
    rate = n = turn = 0
    for packets in streams.values():
        magic, rate, index, n, turn, _ = HEAD.unpack(packets[0][1])
        if magic != MAGIC or index in dealt:
            raise ValueError("unknown stream")
        at = positions(packets[1:], len) if len(packets) > 1 else []
        if at and (at[0] != len(packets[1][1]) or at[-1] != sum(len(d) for _, d in packets[1:])):
            raise ValueError("granule positions do not follow the samples")
        dealt[index], times[index] = [d for _, d in packets[1:]], [x / rate for x in at]
    total = sum(map(len, dealt.values()))
    order = [k // turn % n for k in range(total)]
    if sorted(dealt) != list(range(n)) or any(len(dealt[i]) != order.count(i) for i in range(n)):
        raise ValueError("a stream is missing or short")
    left = [iter(dealt[i]) for i in range(n)]
    whole = b"".join(next(left[i]) for i in order)
    return whole, {"streams": len(streams), "packets": total, "pages": media_pages(media), "seconds": len(whole) / rate if rate else 0.0, "times": times}


def media_pages(media: bytes) -> int:
    """Number of pages, by walking the headers."""
    at = n = 0
    while at < len(media):
        segments = media[at + 26]
        at += HEADER.size + segments + sum(media[at + HEADER.size : at + HEADER.size + segments])
        n += 1
    return n


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text's UTF-8 bytes, padded by :func:`pad64`, as an Ogg file.

    Null text is empty and gives 64 bytes 0. Nulls in the key and repeated rows are kept as
    they are, other columns ignored; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for piece, texts in slices(batches, "text_"):
            raw = texts.cast(pa.large_binary()).to_pylist()
            media = [encode_samples(pad64(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["key_", "n_bytes", "media"])

    rows = docs.selectExpr(f"`{key}` AS key_", f"CAST(`{text}` AS STRING) AS text_")
    return rows.mapInArrow(run, f"key_ {kind}, n_bytes long, media binary").withColumnRenamed("key_", key)


#: Samples are described in this many equal stretches.
STRETCHES = 4


def decode(media: DataFrame, *, key: str = "doc_id", keep_samples: bool = False) -> DataFrame:
    """Read Ogg files of 8-bit samples back: digests, container facts and a feature string.

    A file that is damaged raises; null media (no file) gives nulls in all results. The
    feature string has streams, packets, pages, seconds, the times at which each stream's first
    and last packet end, and the mean sample of four stretches.
    """
    ship_package(media.sparkSession)
    kind = media.select(key).schema[0].dataType.simpleString()
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", samples binary" if keep_samples else "")

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * (6 + keep_samples)
        samples, facts = decode_samples(data)
        level = ",".join(f"{x.mean():.3f}" if len(x) else "-" for x in np.array_split(np.frombuffer(samples, np.uint8), STRETCHES))
        # Ends of the first and the last packet of each stream, as the pages' positions give them.
        ends = ",".join(f"{t[0]:.6f}-{t[-1]:.6f}" if t else "-" for _, t in sorted(facts["times"].items()))
        feature = f"ogg;streams={facts['streams']};packets={facts['packets']};pages={facts['pages']};seconds={facts['seconds']:.6f};times={ends};level={level}"
        return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, *([samples] if keep_samples else []))

    rows = media.selectExpr(f"`{key}` AS key_", "n_bytes", "media").mapInArrow(lambda b: _decoded(b, one, keep_samples), f"key_ {kind}, n_bytes long, {fields}")
    return rows.withColumnRenamed("key_", key)


def _decoded(batches, one, keep_samples):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 6 + keep_samples]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples"][: 6 + keep_samples]
    for batch in batches:
        found = [one(x.as_py()) for x in batch.column(2)]
        columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(batch.column(1), pa.int64()), *columns], ["key_", "n_bytes", *names])
