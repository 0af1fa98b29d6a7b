"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps, for every stretch of text, an agenda of its adjacent symbol pairs ordered
by score and then from left to right; the best pair is joined and its two neighbours are
scored anew, until no pair is a piece. The agendas of all short stretches of an Arrow batch
are worked in lockstep: each step pops the best pair of every stretch at once. Long stretches
have an agenda of buckets by score, so that a step costs what it joins and not the stretch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelworks.llm.common import WordCache, ragged, ship_package, slices, utf8_buffer

SPACE = "\u2581"
_NONE = np.int64(1) << np.int64(62)
#: Symbols from which a stretch counts as long.
LONG = 256


class Vocabulary:
    """Pieces of a SentencePiece BPE model, read through the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = sp.id_to_piece(list(range(n)))
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {pieces[i]: i for i in normal}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if any(not sp.is_byte(int(i)) for i in self.byte):
            raise ValueError("a vocabulary with byte fallback is needed")
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("pieces that go on past a space are not supported")
        #: Symbol of each code point: the piece of that character, or none (-1).
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = sorted((i for i in normal if len(pieces[i]) > 1), key=lambda i: -sp.get_score(i))
        rank, last = {}, None
        for i in order:
            score = sp.get_score(i)
            rank[i] = len(rank) if score != last else rank[previous]
            last, previous = score, i
        pairs = {}
        for i in order:
            p = pieces[i]
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * n + ids[p[k:]]] = (rank[i], i)
        self.n = n
        self._table(pairs)
        self.cache = {True: WordCache(400_000), False: WordCache(400_000)}
        self.digits = [str(i).encode() + b"," for i in range(n)]
        self.digit_length = np.array([len(x) for x in self.digits], np.int64)
        self.digit_start = np.cumsum(self.digit_length) - self.digit_length
        self.digit_bytes = np.frombuffer(b"".join(self.digits), np.uint8)

    def _table(self, pairs: dict[int, tuple[int, int]]) -> None:
        """Open-addressed table of the pairs."""
        self.bits = max(4, (8 * max(1, len(pairs)) - 1).bit_length())
        size = 1 << self.bits
        keys, ranks, made = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        left = np.array(list(pairs), np.int64)
        value = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        step = 0
        while len(left):
            at = (self._slot(left) + step) & (size - 1)
            free = np.flatnonzero(keys[at] < 0)
            chosen = free[np.unique(at[free], return_index=True)[1]]
            keys[at[chosen]], ranks[at[chosen]], made[at[chosen]] = left[chosen], value[chosen, 0], value[chosen, 1]
            stay = np.ones(len(left), np.bool_)
            stay[chosen] = False
            left, value = left[stay], value[stay]
            step += 1
        self.keys, self.ranks, self.made, self.probes = keys, ranks, made, step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined piece) of symbol pairs; rank -1 where the two do not join."""
        key = np.where((a < 0) | (b < 0), np.int64(-2), a * self.n + b)
        slot = self._slot(key)
        hit = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for step in range(self.probes):
            at = (slot[todo] + step) & ((1 << self.bits) - 1)
            k = self.keys[at]
            hit[todo] = np.where(k == key[todo], at, hit[todo])
            todo = todo[(k != key[todo]) & (k >= 0)]
            if not len(todo):
                break
        found = hit >= 0
        return np.where(found, self.ranks[hit], -1), np.where(found, self.made[hit], -1)

    def encode_stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, number of ids of each); spaces are already written as U+2581."""
        raw, offsets = utf8_buffer(stretches)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        owner_offsets = heads[offsets]
        symbol = self.char[points]
        owner = np.repeat(np.arange(len(stretches)), np.diff(owner_offsets))
        alive = self._join(symbol, owner, len(stretches))
        kept = np.flatnonzero(alive)
        ids, who, missing = symbol[kept], owner[kept], symbol[kept] < 0
        if not missing.any():
            return ids, np.bincount(who, minlength=len(stretches))
        point = points[kept]
        width = np.where(missing, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        starts = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])[kept]
        out = np.repeat(ids, width)
        at = np.repeat(missing, width)
        out[at] = self.byte[raw[ragged(starts[missing], width[missing])]]
        return out, np.bincount(who, weights=width, minlength=len(stretches)).astype(np.int64)

    def _join(self, symbol: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Join pairs in ``symbol`` in place; returns which positions still begin a symbol."""
        size = len(symbol)
        alive = np.ones(size, np.bool_)
        if size < 2:
            return alive
        nxt, prv = np.arange(1, size + 1), np.arange(-1, size - 1)
        end = np.concatenate([owner[1:] != owner[:-1], [True]])
        nxt[end] = -1
        prv[np.concatenate([[True], end[:-1]])] = -1
        agenda, made = np.full(size, _NONE), np.full(size, -1, np.int64)
        shift = np.int64(max(1, int(size).bit_length()))

        def score(at: np.ndarray) -> None:
            right = nxt[at]
            rank, joined = self.find(symbol[at], np.where(right >= 0, symbol[right], -1))
            agenda[at] = np.where(rank >= 0, (rank << shift) | at, _NONE)
            made[at] = joined

        score(np.arange(size))
        counts = np.bincount(owner, minlength=n)
        if counts.max() > LONG:
            long = counts[owner] > LONG
            self._join_long(np.flatnonzero(long & (agenda < _NONE)), agenda >> shift, symbol, made, alive, nxt, prv)
            agenda[long] = _NONE
        active = np.flatnonzero(agenda < _NONE)
        live = np.unique(owner[active])
        first = np.zeros(n + 1, np.int64)
        first[1:] = np.cumsum(counts)
        while len(live):
            length = counts[live]
            at = ragged(first[live], length)
            queue = agenda[at]
            heads = np.cumsum(length) - length
            for _ in range(6):
                best = np.minimum.reduceat(queue, heads)
                top = best[best < _NONE] & ((np.int64(1) << shift) - 1)
                if not len(top):
                    break
                gone = nxt[top]
                after = nxt[gone]
                symbol[top] = made[top]
                alive[gone] = False
                nxt[top] = after
                linked = after >= 0
                prv[after[linked]] = top[linked]
                agenda[gone] = _NONE
                before = prv[top]
                score(np.concatenate([top, before[before >= 0]]))
                queue = agenda[at]
            live = live[np.minimum.reduceat(queue, heads) < _NONE]
        return alive


    def _join_long(self, at: np.ndarray, rank: np.ndarray, symbol: np.ndarray, made: np.ndarray, alive: np.ndarray, nxt: np.ndarray, prv: np.ndarray) -> None:
        """Join pairs by an agenda of buckets, one for each rank, the best bucket first.

        Where a pair is worse than what it is made of, joining a bucket adds to later buckets
        only, and all its pairs can be joined at once, from left to right where they overlap.
        If a join makes a pair that is no worse, the step is undone and only the leftmost pair
        joined, so that the better one comes next.
        """
        buckets: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray) -> None:
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            r = rank[places]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for part in np.split(places, cuts) if len(places) else ():
                own = int(rank[part[0]])
                if own not in buckets:
                    buckets[own] = []
                    heapq.heappush(queue, own)
                buckets[own].append(part)

        add(at)
        while queue:
            best = heapq.heappop(queue)
            top = np.sort(np.concatenate(buckets.pop(best)))
            top = top[alive[top] & (rank[top] == best)]
            top = top[np.append(True, top[1:] != top[:-1])] if len(top) else top
            if len(top) > 1:
                # Of pairs that overlap in a row the first, third, ... are joined.
                index = np.arange(len(top))
                follows = np.append(False, nxt[top[:-1]] == top[1:])
                top = top[(index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0]
            if not len(top):
                continue
            places, ranks, joined = self._joined(top, symbol, made, alive, nxt, prv)
            if len(top) > 1 and ((ranks >= 0) & (ranks <= best)).any():
                self._part(top, symbol, alive, nxt, prv)
                top, rest = top[:1], top[1:]
                places, ranks, joined = self._joined(top, symbol, made, alive, nxt, prv)
                buckets[best] = [rest]
                heapq.heappush(queue, best)
            rank[self.gone] = -1
            rank[places], made[places] = ranks, joined
            add(places[ranks >= 0])

    def _joined(self, top, symbol, made, alive, nxt, prv):
        """Join the pairs at ``top``: (places whose pair is another now, its rank, its piece)."""
        self.gone = gone = nxt[top]
        self.before = symbol[top]
        after = nxt[gone]
        symbol[top] = made[top]
        alive[gone] = False
        nxt[top] = after
        linked = after >= 0
        prv[after[linked]] = top[linked]
        left = prv[top]
        places = np.concatenate([top, left[left >= 0]])
        right = nxt[places]
        return places, *self.find(symbol[places], np.where(right >= 0, symbol[right], -1))

    def _part(self, top, symbol, alive, nxt, prv) -> None:
        """Undo the last :meth:`_joined`."""
        symbol[top] = self.before
        alive[self.gone] = True
        after = nxt[top]
        nxt[top] = self.gone
        linked = after >= 0
        prv[after[linked]] = self.gone[linked]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, kept for the process."""
    return Vocabulary(path)


#: A space followed by another, or around a line end, at either end, or a literal U+2581.
_ODD_SPACES = "(^ )|( $)|(  )|( \\n)|\u2581"
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}\\n]+|\\n|{SPACE}+")


def stretches_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut where no pair can join, spaces as U+2581, and how many stretches each has.

    A cut goes before every run of spaces (no piece goes on past a space into a word) and on
    both sides of a line end. The whole text gets one space in front, as the library adds.
    """
    empty = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(text, _ODD_SPACES).to_numpy(zero_copy_only=False) & ~empty
    plain = pc.if_else(pa.array(odd | empty), "", text)
    # A stretch "\nword" stands for a line end and a word without a space before it.
    parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    flat = pc.if_else(pc.starts_with(flat, "\n"), flat, pc.binary_join_element_wise(SPACE, flat, ""))
    if not (odd.any() or empty.any()):
        return flat, counts
    rows, start = [], np.cumsum(counts) - counts
    for i in np.flatnonzero(odd | empty):
        cut = _STRETCH.findall(SPACE + text[int(i)].as_py().replace(" ", SPACE)) if odd[i] else []
        rows.append((int(i), cut))
    pieces, at = [], 0
    for i, cut in rows:
        pieces.append(flat.slice(at, int(start[i]) - at))
        pieces.append(pa.array(cut, flat.type))
        at, counts[i] = int(start[i]) + int(counts[i]), len(cut)
    pieces.append(flat.slice(at))
    return pa.concat_arrays(pieces), counts


def encode_texts(text: pa.Array, vocab: Vocabulary, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each) of a null-free string array.

    check: every different stretch is encoded by the library too when it is first met, and the
    two must agree.
    """
    flat, counts = stretches_of(text)
    code = flat.dictionary_encode()

    def unknown(stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = vocab.encode_stretches(stretches)
        if check:
            _compare(stretches, ids, lengths, vocab)
        return ids, lengths

    known, starts, lengths = vocab.cache[check].get(code.dictionary, unknown)
    index = code.indices.to_numpy()
    each = lengths[index] if len(index) else np.empty(0, np.int64)
    out = known[ragged(starts[index], each)] if len(index) else np.empty(0, np.int64)
    bound = np.concatenate([[0], np.cumsum(each)])
    ends = np.cumsum(counts)
    return out, bound[ends] - bound[ends - counts]


def _compare(stretches: pa.Array, ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> None:
    """Encode stretches by the library, and raise if the ids differ.

    The library puts a space in front itself; a stretch without one follows a line end here
    so that nothing joins across.
    """
    spaced = pc.starts_with(stretches, SPACE).to_numpy(zero_copy_only=False)
    given = pc.if_else(pa.array(spaced), pc.utf8_slice_codeunits(stretches, 1), pc.binary_join_element_wise("\n", stretches, "")).to_pylist()
    lead = len(vocab.library.encode("\n"))
    blank = [int(i) for i in np.flatnonzero(spaced) if not given[i]]
    theirs = vocab.library.encode(given, num_threads=1)
    for i in blank:
        theirs[i] = [int(vocab.char[ord(SPACE)])]
    own = np.fromiter((len(x) for x in theirs), np.int64, len(theirs)) - np.where(spaced, 0, lead)
    flat = np.fromiter((i for x, s in zip(theirs, spaced) for i in (x if s else x[lead:])), np.int64, int(own.sum()))
    if not (np.array_equal(own, lengths) and np.array_equal(flat, ids)):
        raise RuntimeError("the encoder and the sentencepiece library disagree")


def digit_digests(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[str]:
    """SHA-256 of each text's decimal ids joined by commas."""
    width = vocab.digit_length[ids]
    data = vocab.digit_bytes[ragged(vocab.digit_start[ids], width)].tobytes()
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)])]
    view = memoryview(data)
    return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encode(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """(key, ids array<int>): every whole text encoded as the library does, without begin or end ids.

    Null text is empty and has no ids. A null key and repeated rows stay, other columns are
    ignored, an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(model)
        for piece, texts in slices(batches, "text_"):
            ids, counts = encode_texts(texts, vocab, check)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["key_", "ids"])

    rows = docs.selectExpr(f"`{key}` AS key_", f"CAST(`{text}` AS STRING) AS text_")
    return rows.mapInArrow(run, f"key_ {kind}, ids array<int>").withColumnRenamed("key_", key)


def round_trip(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text, encoded here and decoded by the library.

    Null text is empty and has no ids. Null and repeated keys and rows stay, other columns are
    ignored, an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(model)
        for piece, texts in slices(batches, "text_"):
            ids, counts = encode_texts(texts, vocab, check)
            bound = np.concatenate([[0], np.cumsum(counts)])
            flat = ids.tolist()
            lists = [flat[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
            decoded = [hashlib.sha256(x.encode()).hexdigest() for x in vocab.library.decode(lists, num_threads=1)] if lists else []
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts, pa.int64()), pa.array(digit_digests(ids, counts, vocab)), pa.array(decoded)], ["key_", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr(f"`{key}` AS key_", f"CAST(`{text}` AS STRING) AS text_")
    return rows.mapInArrow(run, f"key_ {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key_", key)
