"""LM scoring: logistic mixing of context bit predictors.

A text is its tokens: words (A-Z lower-cased) and one end. Frequent words, the end and an
escape have binary codes (Huffman over the training counts). Every code bit is predicted by
two contexts - the word before, and that word's class (the very frequent word that follows it
most often, which tells the language) - whose log-odds are combined by weights that a gate
selects, and the mixture is refined by an adaptive table. (Without a context the two sides of
a code bit are about even by Huffman's rule.) Before the code stands
one more bit: whether the word that followed the same two words when they came last in the
text follows again. After an escape comes the word itself: its bytes are coded in the same
manner from the one to four bytes before, interpolated with the word's own training count.

The counts of a word's contexts are exact at every size: pairs of a context and a symbol are
counted by a shuffle. What follows a very frequent word is held whole - FREQUENT times HEAD
numbers at most - and broadcast; what follows any other word stays distributed, and the
tokens after such a word are sent to it. A token's probability depends on its pair (and the
match) alone, so every pair is computed once by a task. Spelling contexts are hashed into
tables of a fixed size.

Counts, mixing weights and refinement cover all training texts. Weights are fitted by online
Newton steps over blocks of bits, each bit's own count taken out first; groups of contexts do
so apart, and their results are summed weighted by their curvature.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.common import SMALL_SLICE, Words, give_back, materialise, merged, multipliers, ship_package, slices

#: Words with a code of their own, at most, and their bytes, at most; all others are spelled.
HEAD, HEAD_BYTES = 131_072, 64
#: Words seen less often have no code: they stand for the words that training lacks.
LEAST = 2
#: Very frequent words: contexts that are broadcast, and (the first CLASSES of them) classes of contexts.
FREQUENT, CLASSES = 64, 64
#: Bytes before that predict a spelling's next one; bits of a spelling table.
ORDERS, BITS = 4, 19
#: Bytes of words that are spelled at once.
SPELLING_BYTES = 4 << 20
#: Longest run of matches that is told apart.
RUNS = 16
END = "\n"
#: A table travels in so many parts; each part is summed over so many tasks at a time.
PARTS, TOGETHER = 16, 128
#: Code bits that are worked at once.
EVENTS = 1 << 18
#: Bits of a symbol; tokens that a task gathers before it sends them.
WIDTH, LATER = 18, 1 << 20
MASK = (1 << WIDTH) - 1
#: A bucket of contexts for about so many training tokens, at most so many buckets, and buckets of one task.
BUCKET_TOKENS, MOST_BUCKETS, BUCKETS_AT_ONCE = 400_000, 1 << 14, 8
#: A bucket's results go back by blocks of 2 ** BLOCK documents; tasks that score buckets, at least.
BLOCK, TASKS = 12, 64
#: The group of the match counts, which travel with the pairs.
ODDS = -1 << 40
#: Depths of code bits that are refined apart, and the steps of the refinement table.
DEPTHS, STEPS = 16, 33


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text, mod 7, is 2 (false for a null key)."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


class Code:
    """Binary codes by Huffman's rule: for each symbol the inner nodes passed and the bits taken."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        heap = [(int(c), i) for i, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        parent, bit = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        nxt = n
        weight = np.zeros((2 * n - 1, 2), np.float64)
        while len(heap) > 1:
            (ca, a), (cb, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[[a, b]], bit[b] = nxt, 1
            weight[nxt] = ca, cb
            heapq.heappush(heap, (ca + cb, nxt))
            nxt += 1
        depth = np.zeros(2 * n - 1, np.int64)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        self.length = depth[:n]
        self.start = np.cumsum(self.length) - self.length
        total = int(self.length.sum())
        self.node, self.bit = np.zeros(total, np.int32), np.zeros(total, np.int8)
        at, place = np.arange(n), self.start + self.length - 1
        live = np.flatnonzero(self.length)
        for _ in range(int(self.length.max()) if n > 1 else 0):
            self.node[place[live]] = parent[at[live]] - n
            self.bit[place[live]] = bit[at[live]]
            at[live], place[live] = parent[at[live]], place[live] - 1
            live = live[place[live] >= self.start[live]]
        self.zero, self.one = weight[n:].T if n > 1 else (np.zeros(0), np.zeros(0))

    def events(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index in ``symbols``, depth, node, bit) of every code bit."""
        length, start = self.length[symbols], self.start[symbols]
        owner = np.repeat(np.arange(len(symbols), dtype=np.int32), length)
        ends = np.cumsum(length)
        depth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        at = np.repeat(start, length) + depth
        return owner, depth.astype(np.int32), self.node[at], self.bit[at]


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Table index of a context (a hash) and an inner node."""
    odd = multipliers(4)
    key = node.astype(np.uint64)
    key *= odd[2]
    key += context
    key *= odd[3]
    key >>= np.uint64(64 - BITS)
    return key.view(np.int64)


def stretch(zero, one):
    return np.log((one + 0.4) / (zero + 0.4))


def confidence(zero, one):
    return np.minimum(np.log2(zero + one + 1) / 3, 3).astype(np.int64)


def pack(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log-odds in steps of 1/400 and the confidence of counts, in 16 bits."""
    s = np.rint(np.clip(stretch(zero, one), -20, 20) * 400).astype(np.int64) + 8192
    return (s << 2 | confidence(zero, one)).astype(np.uint16)


#: What counts of 0 and 0 give.
UNSEEN = 8192 << 2
_VALUE = ((np.arange(1 << 16) >> 2) - 8192).astype(np.float32) / np.float32(400)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, confidence) of packed counts."""
    return _VALUE.take(packed), packed & np.uint16(3)


def _without_own() -> np.ndarray:
    """[bit, packed counts] -> packed counts without one such bit; those of many counts stay as they are."""
    out = np.tile(np.arange(1 << 16, dtype=np.uint16), (2, 1))
    n, one = np.array([(n, o) for n in range(30, 0, -1) for o in range(n + 1)]).T
    at = pack(n - one, one)
    out[0, at] = pack(np.maximum(n - one - 1, 0), one)
    out[1, at] = pack(n - one, np.maximum(one - 1, 0))
    return out


WITHOUT_OWN = _without_own()


@dataclass
class Mixer:
    """Gated weights (the last input is 1), and the refinement over (row, step of the mixture's log-odds)."""

    weights: np.ndarray
    table: np.ndarray

    def log10_of(self, bit: np.ndarray, inputs: list[np.ndarray], gate: np.ndarray, row: np.ndarray) -> np.ndarray:
        """log10 probability of each bit, in single precision (sums are made in double)."""
        if "single" not in self.__dict__:
            self.single = np.ascontiguousarray(self.weights.T, np.float32), self.table.astype(np.float32).ravel()
        weights, table = self.single
        s = weights[-1].take(gate)
        for x, w in zip(inputs, weights):
            s += w.take(gate) * x
        np.clip(s, -16, 16, out=s)
        place = np.clip(s, -7.99, 7.99) * np.float32(2) + np.float32(16)
        at = place.astype(np.int32)
        place -= at
        at += row * np.int32(STEPS)
        low = table.take(at)
        at += 1
        refined = low + place * (table.take(at) - low)
        np.negative(s, out=s)
        p = (1 / (1 + np.exp(s)) + refined) * np.float32(0.5)
        p = np.where(bit, p, 1 - p)
        np.clip(p, 1e-7, 1 - 1e-7, out=p)
        return np.log10(p)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "single"}


class Learner:
    """Online Newton steps on the log loss of gated mixtures, and counts for the refinement table."""

    def __init__(self, gates: int, inputs: int, rows: int):
        self.shape = gates, inputs + 1, rows
        self.start = np.full((gates, inputs + 1), 1.0 / inputs)
        self.start[:, -1] = 0
        self.prior = 200.0 * np.eye(inputs + 1)
        self.weights, self.curve = self.start.copy(), np.tile(self.prior, (gates, 1, 1))
        self.seen = np.zeros((2, rows * STEPS))

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, row: np.ndarray, bit: np.ndarray, times: np.ndarray, block: int = 1 << 15) -> None:
        """In the order given; ``times``: how often each bit was seen."""
        for low in range(0, len(gate), block):
            x = np.empty((len(gate[low : low + block]), self.shape[1]))
            for i, v in enumerate(inputs):
                x[:, i] = v[low : low + block]
            x[:, -1] = 1
            g, r, y, n = gate[low : low + block], row[low : low + block], bit[low : low + block], times[low : low + block]
            s = np.clip(np.einsum("ij,ij->i", self.weights[g], x), -16, 16)
            place = np.clip(s, -7.99, 7.99) * 2 + 16
            at = place.astype(np.int64)
            part = place - at
            at += r * STEPS
            size = self.shape[2] * STEPS
            for k, w in ((0, n * (1 - part)), (1, n * part)):
                self.seen[0] += np.bincount(at + k, w * y, size)
                self.seen[1] += np.bincount(at + k, w, size)
            p = 1 / (1 + np.exp(-s))
            error, curve = n * (y - p), n * np.maximum(p * (1 - p), 1e-3)
            order = np.argsort(g.astype(np.uint8), kind="stable")
            ends = np.cumsum(np.bincount(g, minlength=self.shape[0]))
            for i in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                own = order[ends[i - 1] if i else 0 : ends[i]]
                xi = x[own]
                self.curve[i] += (xi * curve[own, None]).T @ xi
                self.weights[i] += np.linalg.solve(self.curve[i], xi.T @ error[own])

    def sums(self) -> np.ndarray:
        """What is to be summed over learners, as one array."""
        curve = self.curve - self.prior
        moved = np.einsum("gij,gj->gi", self.curve, self.weights) - self.start @ self.prior
        return np.concatenate([curve.ravel(), moved.ravel(), self.seen.ravel()])

    def result(self, sums: np.ndarray) -> Mixer:
        """The mixer of learners' summed arrays."""
        gates, k, rows = self.shape
        curve = sums[: gates * k * k].reshape(gates, k, k) + self.prior
        moved = sums[gates * k * k : gates * k * (k + 1)].reshape(gates, k) + self.start @ self.prior
        one, all_ = sums[gates * k * (k + 1) :].reshape(2, rows * STEPS)
        edge = np.tile(1 / (1 + np.exp(-(np.arange(STEPS) - 16) / 2)), rows)
        return Mixer(np.linalg.solve(curve, moved[..., None])[..., 0], ((one + 20 * edge) / (all_ + 20)).reshape(rows, STEPS))


def _summed(stats: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays in the column stats: ``size`` rows come to the driver."""
    out = np.zeros(size)
    for r in stats.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


class WordModel:
    """Codes, counts and weights of the words that have codes."""

    def __init__(self, words: list[str], counts: np.ndarray, escaped: int, tokens: int, types: int):
        self.words, self.counts = pa.array(words, pa.large_string()), counts
        self.tokens, self.types, self.escaped = tokens, types, escaped
        self.code = Code(np.append(np.maximum(counts, 1), max(1, escaped)))
        self.escape = len(words)
        #: Contexts are the symbols before, and ``none`` at a text's begin.
        self.none = self.escape + 1
        self.end = words.index(END) if END in words else self.escape
        #: Row of every context that is held whole; -1 of others.
        self.row = np.full(self.escape + 2, -1)
        self.row[: min(FREQUENT, self.escape)] = np.arange(min(FREQUENT, self.escape))
        self.row[self.escape :] = FREQUENT, FREQUENT + 1
        self.class_of = np.full(self.escape + 2, CLASSES, np.int32)
        #: Packed counts (row or class, node), once they are known; a class of none has no counts.
        self.dense: np.ndarray | None = None
        self.classes: np.ndarray | None = None
        #: log10 of the chance that a match holds, and that it does not, by the run of matches before.
        self.match_odds = np.full((2, RUNS), math.log10(0.5))
        #: (g, n, pair, c): the pairs of a context and a symbol with their counts, packed by group (see unpack_pairs).
        self.pairs: DataFrame | None = None
        self.buckets = min(MOST_BUCKETS, max(16, tokens // BUCKET_TOKENS))
        self.mixer: Mixer | None = None

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k not in ("known", "pairs")}
        for name in ("dense", "classes"):
            if state[name] is not None:
                state[name] = state[name].shape, [zlib.compress(x.tobytes(), 1) for x in state[name]]
        return state

    def __setstate__(self, state):
        self.__dict__ |= state
        for name in ("dense", "classes"):
            if state[name] is None:
                continue
            shape, rows = state[name]
            table = np.empty(shape, np.uint16)
            for i, x in enumerate(rows):
                table[i] = np.frombuffer(zlib.decompress(x), np.uint16)
            setattr(self, name, table)

    def group(self, context: np.ndarray) -> np.ndarray:
        """-1 - the context if that is held whole, else its bucket."""
        return np.where(self.row[context] >= 0, -1 - context, mixed_order(context) * self.buckets >> WIDTH)

    def context(self, t: Tokens) -> np.ndarray:
        """The symbol before every token."""
        out = np.empty(len(t.symbol), np.int64)
        out[1:] = t.symbol[:-1]
        out[t.first] = self.none
        return out

    def matches(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places with a match, whether it holds, run of matches that held right before, below RUNS).

        A match is the symbol that followed the same two symbols when they came last in the text.
        """
        n = len(t.symbol)
        position = np.arange(n) - t.first[t.doc]
        at = np.flatnonzero(position >= 2)
        if not len(at):
            return at, np.empty(0, np.bool_), at
        odd = multipliers(12)
        key = t.symbol.astype(np.uint64)
        pair = (key[at - 1] * odd[9] + key[at - 2] * odd[10]) ^ (t.doc[at].astype(np.uint64) * odd[11])
        # Equal pairs in order of place: the hash's upper bits and the place in one number.
        shift = np.uint64(int(n).bit_length())
        both = np.sort((pair >> shift << shift) | at.astype(np.uint64))
        place = (both & ((np.uint64(1) << shift) - np.uint64(1))).view(np.int64)
        same = np.flatnonzero(both[1:] >> shift == both[:-1] >> shift)
        now, last = place[same + 1], place[same]
        true = (t.symbol[now - 1] == t.symbol[last - 1]) & (t.symbol[now - 2] == t.symbol[last - 2])
        now, last = now[true], last[true]
        held = t.symbol[now] == t.symbol[last]
        hit = np.zeros(n, np.bool_)
        hit[now[held]] = True
        index = np.arange(n)
        miss = np.maximum.accumulate(np.where(hit, -1, index))
        run = np.minimum(now - 1 - miss[now - 1], np.minimum(position[now] - 2, RUNS - 1))
        return now, held, np.maximum(run, 0)

    def node_counts(self, pair: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context and node as one number, zeros, ones, depth) of the pairs' bits."""
        owner, depth, node, bit = self.code.events(pair & MASK)
        code = pa.array((pair >> WIDTH)[owner] * max(1, self.escape) + node).dictionary_encode()
        key, at = code.dictionary.to_numpy(), code.indices.to_numpy()
        weight = c[owner].astype(np.float64)
        total = np.bincount(at, weights=weight, minlength=len(key))
        one = np.bincount(at, weights=weight * bit, minlength=len(key))
        of = np.zeros(len(key), np.int32)
        of[at] = depth
        return key, total - one, one, of

    def learner(self) -> Learner:
        return Learner(16, 2, DEPTHS)

    def learn(self, learner: Learner, key: np.ndarray, zero: np.ndarray, one: np.ndarray, depth: np.ndarray) -> None:
        """All bits of the contexts and nodes ``key``, each without its own count."""
        context, node = np.divmod(key, max(1, self.escape))
        classes = self.classes[self.class_of[context], node]
        row = np.minimum(depth, DEPTHS - 1)
        for bit, n in ((0, zero), (1, one)):
            at = np.flatnonzero(n)
            first = pack(zero[at] - (bit == 0), one[at] - (bit == 1))
            x, sure = unpack(first)
            x2, sure2 = unpack(WITHOUT_OWN[bit][classes[at]])
            learner.learn([x, x2], sure.astype(np.int64) * 4 + sure2, row[at], np.full(len(at), bit), n[at])

    def score_pairs(self, context: np.ndarray, symbol: np.ndarray, first) -> np.ndarray:
        """log10 probability of every symbol's code after its context; ``first(index, node)`` gives the packed counts."""
        out = np.zeros(len(symbol))
        flat, base = self.classes.reshape(-1), self.class_of[context].astype(np.int64) * self.escape
        for low, high in chunks(self.code, symbol):
            owner, depth, node, bit = self.code.events(symbol[low:high])
            x, sure = unpack(first(low + owner, node))
            x2, sure2 = unpack(flat.take(base[low:high][owner] + node))
            bits = self.mixer.log10_of(bit, [x, x2], sure * np.uint16(4) + sure2, np.minimum(depth, DEPTHS - 1))
            out[low:high] = np.bincount(owner, weights=bits, minlength=high - low)
        return out

    def score_own(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of symbols after contexts that are held whole, in steps of 1 / 4096.

        Each pair is computed once in a process (improbable ones, below 10 ** -15, each time).
        """
        if "known" not in self.__dict__:
            self.known = np.zeros((FREQUENT + 2) * (self.escape + 1), np.uint16)
        pair = self.row[context] * (self.escape + 1) + symbol
        got = self.known.take(pair).astype(np.int64)
        new, at = np.unique(pair[got == 0], return_inverse=True)
        if len(new):
            r, s = np.divmod(new, self.escape + 1)
            back = np.append(np.arange(FREQUENT), (self.escape, self.none))
            flat = self.dense.reshape(-1)
            score = np.rint(self.score_pairs(back[r], s, lambda i, node: flat.take(r[i] * self.escape + node)) * -4096).astype(np.int64)
            score = np.maximum(score, 1)
            self.known[new] = np.where(score < 15 * 4096, score, 0)
            got[got == 0] = score[at]
        return got / -4096

    def with_match(self, score: np.ndarray, run: np.ndarray) -> np.ndarray:
        """log10 probability of symbols that a match foretold, ``run`` matches having held before."""
        hold, fail = self.match_odds[:, run]
        return np.log10(10**hold + 10 ** (fail + score))


def chunks(code: Code, symbol: np.ndarray):
    """Ranges of symbols with about EVENTS code bits."""
    total = np.cumsum(code.length[symbol])
    low = 0
    while low < len(symbol):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + EVENTS, "right")))
        yield low, high
        low = high


class Tokens:
    """The tokens of texts: each text's words and then the end, as symbols of a word model."""

    def __init__(self, text: pa.Array, model: WordModel):
        words = Words(text, lower=True)
        names = words.array()
        own = pc.fill_null(pc.index_in(names, value_set=model.words), model.escape).to_numpy().astype(np.int64)
        self.counts = words.counts + 1
        ends = np.cumsum(self.counts)
        self.first = ends - self.counts
        self.symbol = np.full(int(ends[-1]) if len(ends) else 0, model.end)
        at = np.arange(len(words)) + words.doc
        self.symbol[at] = own
        self.doc = np.repeat(np.arange(len(text)), self.counts)
        #: Text and spelling of the tokens that are escaped; the end never is.
        rare = np.flatnonzero(own == model.escape)
        self.rare_doc, self.rare = words.doc[rare], names.take(pa.array(rare))


class SpellingModel:
    """Bytes of a word and an end byte, from the one to four bytes before."""

    def __init__(self, byte_counts: np.ndarray):
        self.code = Code(byte_counts + 1)
        self.tables = np.full((ORDERS, 1 << BITS), UNSEEN, np.uint16)
        self.mixer: Mixer | None = None

    @staticmethod
    def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different runs of a byte and the ORDERS before it, run of each byte, word of each byte); a word ends with byte 32."""
        raw = b" ".join([*words.cast(pa.large_binary()).to_numpy(zero_copy_only=False), b""])
        symbol = np.frombuffer(raw, np.uint8).astype(np.int64)
        end = symbol == 32
        owner = np.cumsum(end) - end
        starts = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1]) if len(symbol) else np.empty(0, np.int64)
        position = np.arange(len(symbol)) - starts[owner]
        key = symbol.copy()
        for k in range(1, ORDERS + 1):
            shifted = np.full(len(symbol), 256)
            shifted[k:] = symbol[:-k]
            shifted[position < k] = 256
            key += shifted * 257**k
        code = pa.array(key).dictionary_encode()
        return code.dictionary.to_numpy(), code.indices.to_numpy(), owner

    def _events(self, gram: np.ndarray):
        """(index in ``gram``, depth, node, bit, slots of each order) for pieces of the runs."""
        step = max(1, EVENTS // 6)
        odd = multipliers(12 + 2 * ORDERS)
        for low in range(0, len(gram), step):
            part = gram[low : low + step]
            owner, depth, node, bit = self.code.events(part % 257)
            total, found = np.zeros(len(part), np.uint64), []
            for k in range(1, ORDERS + 1):
                total = total + (part // 257**k % 257 + 1).astype(np.uint64) * odd[12 + k]
                found.append(slots((total + odd[k])[owner], node))
            yield low + owner, depth, node, bit, found

    def gather(self, words: pa.Array, tables: np.ndarray) -> None:
        """Add the words' bits to the counts (order, slot, bit)."""
        gram, at, _ = self.grams(words)
        times = np.bincount(at, minlength=len(gram))
        for owner, _, _, bit, found in self._events(gram):
            n = times[owner].astype(np.float64)
            for k, s in enumerate(found):
                tables[k] += np.bincount(s * 2 + bit, weights=n, minlength=2 << BITS).astype(np.int64).reshape(-1, 2)

    @staticmethod
    def learner() -> Learner:
        return Learner(64, ORDERS, DEPTHS)

    @staticmethod
    def _gate(sure: list[np.ndarray]) -> np.ndarray:
        return (sure[1].astype(np.int64) * 4 + sure[2]) * 4 + sure[3]

    def learn(self, learner: Learner, words: pa.Array) -> None:
        gram, at, _ = self.grams(words)
        times = np.bincount(at, minlength=len(gram)).astype(np.float64)
        for owner, depth, _, bit, found in self._events(gram):
            got = [unpack(WITHOUT_OWN[bit, self.tables[k][s]]) for k, s in enumerate(found)]
            learner.learn([x for x, _ in got], self._gate([c for _, c in got]), np.minimum(depth, DEPTHS - 1), bit, times[owner])

    def score(self, words: pa.Array) -> np.ndarray:
        """log10 probability of every word's spelling."""
        gram, at, owner_of = self.grams(words)
        out = np.zeros(len(gram))
        for owner, depth, _, bit, found in self._events(gram):
            got = [unpack(self.tables[k].take(s)) for k, s in enumerate(found)]
            bits = self.mixer.log10_of(bit, [x for x, _ in got], self._gate([c for _, c in got]), np.minimum(depth, DEPTHS - 1))
            out += np.bincount(owner, weights=bits, minlength=len(gram))
        return np.bincount(owner_of, weights=out[at], minlength=len(words))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) of all words in the column text_ and the end; c counts those of rows with ``train_``."""

    def run(batches):
        for piece, texts in slices(batches, "text_", SMALL_SLICE):
            train = piece.column(1).to_numpy(zero_copy_only=False)
            words = Words(texts, lower=True)
            coded = words.array().dictionary_encode()
            c = np.bincount(coded.indices.to_numpy()[train[words.doc]], minlength=len(coded.dictionary)) if len(words) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])]), pa.array(np.append(c, train.sum()))], ["word", "c"])

    return rows.select("text_", "train_").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_letters(words: DataFrame) -> DataFrame:
    """(byte, n) over the column word, each word with a space after it."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for _, piece in slices(merged(batches, SPELLING_BYTES), "word", SPELLING_BYTES):
            total += np.bincount(np.frombuffer(b" ".join([*piece.cast(pa.large_binary()).to_numpy(zero_copy_only=False), b""]), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["byte", "n"])

    return words.select("word").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def _spelling_tables(words: DataFrame, shared) -> np.ndarray:
    """Packed tables (order, slot) of the counts of all words.

    Every task sends its counts in compressed parts; a part is summed over TOGETHER tasks,
    then over TOGETHER of these sums, and then in one place, where it is packed. The result's
    size is fixed: ORDERS * 2 ** BITS numbers of 16 bits.
    """

    def send(batches):
        tables = None
        for _, piece in slices(merged(batches, SPELLING_BYTES), "word", SPELLING_BYTES):
            tables = np.zeros((ORDERS, 1 << BITS, 2), np.int64) if tables is None else tables
            shared.value.gather(piece, tables)
        if tables is None:
            return
        group = TaskContext.get().partitionId() // TOGETHER
        for i, part in enumerate(np.split(tables.reshape(-1), ORDERS * PARTS)):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], ["g", "part", "data"])

    def add(table: pa.Table, finish: bool = False) -> pa.Table:
        total = 0
        for x in table.column("data"):
            total = total + np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        group = table.column("g")[0].as_py() // TOGETHER
        if finish:
            total = pack(*total.reshape(-1, 2).T.astype(np.float64))
        return pa.table({"g": pa.array([group], pa.int32()), "part": table.column("part").slice(0, 1), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "g int, part int, data binary"
    sent = words.mapInArrow(send, kind)
    part, finish = (lambda t: add(t)), (lambda t: add(t, True))
    summed = sent.groupBy("part", "g").applyInArrow(part, kind).groupBy("part", "g").applyInArrow(part, kind).groupBy("part").applyInArrow(finish, kind)
    out = np.full((ORDERS * PARTS, (1 << BITS) // PARTS), UNSEEN, np.uint16)
    for r in summed.collect():  # at most ORDERS * PARTS rows
        out[r["part"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint16)
    return out.reshape(ORDERS, 1 << BITS)


@dataclass
class Model:
    """All that scoring needs; its size does not depend on the corpus, but for ``rare`` and ``word.pairs``."""

    word: WordModel
    spelling: SpellingModel
    known_share: float
    rare_tokens: int
    #: (word, c, spelled) of the words in training or scored texts that have no code of their own.
    rare: DataFrame


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> Model:
    """Train on all documents that :func:`held_out` leaves in (null text: empty).

    Words of the other documents are listed too, with count 0, so that each is spelled once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text_"))
    rows = rows.withColumn("train_", ~held_out(F.col("key_")))
    counts = materialise(count_words(rows), "words")
    seen = counts.where("c > 0")
    # Words that may have codes, by eighths of a power of two of their counts: some hundred rows.
    level, short = F.floor(F.log2("c") * 8), F.octet_length("word") <= HEAD_BYTES
    found = seen.groupBy(level.alias("level")).agg(F.count_if(short).alias("n"), F.count("*").alias("types"), F.sum("c").alias("s"), F.count_if(F.col("c") == 1).alias("once")).collect()
    levels = sorted(((r["level"], r["n"]) for r in found), reverse=True)
    tokens, types, once = (sum(r[x] for r in found) for x in ("s", "types", "once"))
    bar, room = math.inf, HEAD - 1
    for value, n in levels:
        if n > room or value < math.floor(math.log2(LEAST) * 8):
            break
        bar, room = value, room - n
    coded = (level >= F.lit(float(bar))) & short & (F.col("c") > 0)
    top = sorted(((r["c"], r["word"]) for r in seen.where(coded | (F.col("word") == END)).collect()), key=lambda r: (-r[0], r[1]))  # at most HEAD rows of HEAD_BYTES
    rare = counts.where(~F.coalesce(coded, F.lit(False)) & (F.col("word") != END))
    head_counts = np.array([c for c, _ in top], np.int64)
    word = WordModel([w for _, w in top], head_counts, tokens - int(head_counts.sum()), tokens, types)
    fit_words(rows.where("train_"), word)
    known = rare.where("c > 0")
    letters = np.zeros(256, np.int64)
    for r in count_letters(known).collect():  # at most 256 rows
        letters[r["byte"]] = r["n"]
    spelling = fit_spelling(known.select("word"), letters)
    # Share of escaped tokens that are words seen in training, by the number seen once.
    share = 1 - min(0.9, max(0.1, once / max(1, word.escaped)))
    return Model(word, spelling, share, word.escaped, materialise(spelled(rare, spelling), "rare"))


#: An odd number and its inverse modulo 2 ** WIDTH.
_SPREAD = 179_381
_BACK = pow(_SPREAD, -1, 1 << WIDTH)


def mixed_order(context: np.ndarray) -> np.ndarray:
    """A number below 2 ** WIDTH for each context, spread evenly and never the same for two."""
    return context * _SPREAD & MASK


def _natural(mixed: np.ndarray) -> np.ndarray:
    """Pairs from numbers whose upper part is the context in mixed order."""
    return ((mixed >> WIDTH) * _BACK & MASK) << WIDTH | mixed & MASK


def pack_pairs(mixed: np.ndarray, c: np.ndarray) -> tuple[bytes, bytes]:
    """Ordered pairs (contexts in mixed order) and their counts as bytes."""
    return _squeeze(np.diff(mixed, prepend=0)), _squeeze(c.astype("<i8"))


def unpack_pairs(n: int, pair: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts): a pair is context << WIDTH | symbol."""
    return _natural(np.cumsum(_expand(pair, n, "<i8"))), _expand(c, n, "<i8")


def _rows(batch: pa.RecordBatch):
    """The rows of a batch one by one, so that large values are copied one at a time."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def _sum_equal(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(c[order], first) if len(key) else c


def fit_words(training: DataFrame, word: WordModel) -> None:
    """Count all contexts and matches of the training texts, and fit the weights to all their bits.

    Pairs travel and are kept as packed groups (a context that is held whole, or a bucket of
    contexts), never as single rows.
    """
    context = training.sparkSession.sparkContext
    shared = context.broadcast(word)
    kind, names = "g long, n long, pair binary, c binary", ["g", "n", "pair", "c"]

    def pairs(batches):
        held, size, odds = [], 0, np.zeros((2, RUNS), np.int64)

        def whole():
            # Contexts that are held whole first, and all in mixed order: groups are runs.
            every = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            c, every = np.diff(np.append(first, len(every))), every[first]
            mixed = every & ((1 << 2 * WIDTH) - 1)
            g = shared.value.group(_natural(mixed) >> WIDTH)
            ends = [*(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            rows = [(int(g[a]), b - a, *pack_pairs(mixed[a:b], c[a:b])) for a, b in zip([0, *ends], ends)]
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        schema = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("pair", pa.binary()), ("c", pa.binary())])
        for _, texts in slices(batches, "text_", SMALL_SLICE):
            model = shared.value
            t = Tokens(texts, model)
            _, hold, run = model.matches(t)
            odds += np.bincount(run + RUNS * ~hold, minlength=2 * RUNS).reshape(2, RUNS)
            before = model.context(t)
            held.append(((model.row[before] < 0).astype(np.int64) << WIDTH | mixed_order(before)) << WIDTH | t.symbol)
            size += len(held[-1])
            if size > 2 * LATER:
                yield whole()
                held, size = [], 0
        if held:
            yield whole()
        yield pa.RecordBatch.from_pylist([{"g": ODDS, "n": 2 * RUNS, "pair": b"", "c": odds.tobytes()}], schema=schema)

    def merge(table: pa.Table) -> pa.Table:
        g, rows = table.column("g")[0].as_py(), list(zip(*(table.column(x).to_pylist() for x in names[1:]), strict=True))
        own = best = b""
        if g == ODDS:
            n, pair, c = 2 * RUNS, b"", sum(np.frombuffer(c, "<i8") for _, _, c in rows).tobytes()
        else:
            mixed, c = _sum_equal(np.concatenate([np.cumsum(_expand(p, n, "<i8")) for n, p, _ in rows]), np.concatenate([_expand(c, n, "<i8") for n, _, c in rows]))
            # A context's class: the very frequent word that follows most often, of equals the most frequent.
            found = _natural(mixed)
            at = np.flatnonzero((found & MASK) < CLASSES)
            before, symbol = found[at] >> WIDTH, found[at] & MASK
            order = np.lexsort((symbol, -c[at], before))
            before, symbol = before[order], symbol[order]
            first = np.append(True, before[1:] != before[:-1])[: len(before)]
            own, best = before[first].tobytes(), symbol[first].tobytes()
            n, (pair, c) = len(mixed), pack_pairs(mixed, c)
            give_back()
        return pa.table({"g": pa.array([g], pa.int64()), "n": pa.array([n], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in (("pair", pair), ("c", c), ("own", own), ("best", best))}})

    tasks = max(8, word.buckets // BUCKETS_AT_ONCE)
    sent = training.select("text_").mapInArrow(pairs, kind).repartition(tasks, "g")
    every = materialise(sent.groupBy("g").applyInArrow(merge, kind + ", own binary, best binary"), "pairs")
    odds = np.zeros(2 * RUNS)
    for r in every.where(F.col("g") == ODDS).select("c").collect():  # one row
        odds = np.frombuffer(r["c"], "<i8").astype(np.float64)
    hold, fail = odds.reshape(2, RUNS)
    word.match_odds = np.log10(np.stack([hold + 0.5, fail + 0.5]) / (hold + fail + 1))
    word.pairs = every.where(F.col("g") != ODDS).select(*names)
    nodes = word.escape
    word.dense, word.classes = (np.full((n, nodes), UNSEEN, np.uint16) for n in (FREQUENT + 2, CLASSES + 1))
    if not nodes:
        word.mixer = word.learner().result(np.zeros(len(word.learner().sums())))
        return
    for r in every.where(F.col("g") != ODDS).select("own", "best").collect():  # two numbers for each of at most HEAD + 2 contexts
        word.class_of[np.frombuffer(r["own"], "<i8")] = np.frombuffer(r["best"], "<i8")
    classes = context.broadcast(word.class_of)

    def by_class(batches):
        total = None
        for b in batches:
            for _, n, pair, c in _rows(b):
                pair, c = unpack_pairs(n, pair, c)
                key = classes.value[pair >> WIDTH].astype(np.int64) << WIDTH | pair & MASK
                total = _sum_equal(*((key, c) if total is None else (np.append(total[0], key), np.append(total[1], c))))
        if total is None:
            return
        own = total[0] >> WIDTH
        ends = [*(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip([0, *ends], ends):
            yield pa.RecordBatch.from_arrays([pa.array([own[a]]), pa.array([b - a]), *(pa.array([x], pa.binary()) for x in pack_pairs(total[0][a:b] & MASK, total[1][a:b]))], names)

    def packed(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(x).to_pylist() for x in names[1:]), strict=True))
        symbol, c = _sum_equal(np.concatenate([np.cumsum(_expand(p, n, "<i8")) for n, p, _ in rows]), np.concatenate([_expand(c, n, "<i8") for n, _, c in rows]))
        key, zero, one, _ = shared.value.node_counts(symbol, c)
        full = np.full(nodes, UNSEEN, np.uint16)
        full[key] = pack(zero, one)
        return pa.table({"g": group.column("g").slice(0, 1), "dense": pa.array([zlib.compress(full.tobytes(), 1)], pa.binary())})

    for r in word.pairs.mapInArrow(by_class, kind).groupBy("g").applyInArrow(packed, "g long, dense binary").collect():  # at most CLASSES + 1 rows
        if r["g"] < CLASSES:
            word.classes[r["g"]] = np.frombuffer(zlib.decompress(r["dense"]), np.uint16)
    # What follows single words is not needed for the fit.
    dense, word.dense = word.dense, None
    fitting = context.broadcast(word)
    word.dense = dense

    def fit(batches):
        model, total = fitting.value, 0
        fields = ["g", "dense", "stats"]
        for b in batches:
            for g, n, pair, c in _rows(b):
                key, zero, one, depth = model.node_counts(*unpack_pairs(n, pair, c))
                learner = model.learner()
                model.learn(learner, key, zero, one, depth)
                total = total + learner.sums()
                give_back()
                if g < 0:
                    full = np.full(nodes, UNSEEN, np.uint16)
                    full[key % nodes] = pack(zero, one)
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([zlib.compress(full.tobytes(), 1)], pa.binary()), pa.nulls(1, pa.list_(pa.float64()))], fields)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.float64()))], fields)

    fitted = materialise(word.pairs.mapInArrow(fit, "g long, dense binary, stats array<double>"), "fitted")
    for r in fitted.where("g < 0").select("g", "dense").collect():  # at most FREQUENT + 2 rows of HEAD numbers
        word.dense[word.row[-1 - r["g"]]] = np.frombuffer(zlib.decompress(r["dense"]), np.uint16)
    learner = word.learner()
    word.mixer = learner.result(_summed(fitted.where("stats IS NOT NULL"), len(learner.sums())))


def fit_spelling(words: DataFrame, letters: np.ndarray) -> SpellingModel:
    """Count and fit the spelling of all words (column word)."""
    context = words.sparkSession.sparkContext
    spelling = SpellingModel(letters)
    spelling.tables = _spelling_tables(words, context.broadcast(spelling))
    shared = context.broadcast(spelling)

    def learn(batches):
        learner = SpellingModel.learner()
        for _, piece in slices(merged(batches, SPELLING_BYTES), "word", SPELLING_BYTES):
            shared.value.learn(learner, piece)
        yield pa.RecordBatch.from_arrays([pa.array([learner.sums()], pa.list_(pa.float64()))], ["stats"])

    learner = SpellingModel.learner()
    spelling.mixer = learner.result(_summed(words.mapInArrow(learn, "stats array<double>"), len(learner.sums())))
    return spelling


def spelled(words: DataFrame, spelling: SpellingModel) -> DataFrame:
    """(word, c, spelled): with the log10 probability of each spelling."""
    shared = words.sparkSession.sparkContext.broadcast(spelling)

    def run(batches):
        for piece, texts in slices(merged(batches, SPELLING_BYTES), "word", SPELLING_BYTES):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(shared.value.score(texts))], ["word", "c", "spelled"])

    return words.select("word", "c").mapInArrow(run, "word string, c long, spelled double")


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first byte of each before the second of each."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _expand(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _score_later(later: DataFrame, word: WordModel, shared) -> DataFrame:
    """(row, later) from rows (bucket, first, n, code, offset) of tokens whose word before is not held whole.

    A code is pair and match (0, or 1 and the run where one held); a bucket's pairs come
    before its tokens, and every different pair is scored once for a batch of tokens.
    """

    def run(batches):
        model = shared.value[0]
        current, table, tokens, size = None, None, [], 0
        rows, sums, many = [], [], 0
        nothing = np.empty(0, np.int64), np.empty(0, np.uint16)

        def flush():
            nonlocal tokens, size, many
            code, row = (np.concatenate(x) for x in zip(*tokens, strict=True))
            coded = pa.array(code).dictionary_encode()
            every, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            pair, held = every >> 5, every & 31
            got = _after(model, pair, *(table or nothing))
            hit = np.flatnonzero(held)
            got[hit] = model.with_match(got[hit], held[hit] - 1)
            coded = pa.array(row).dictionary_encode()
            # (Every document once in each addition.)
            rows.append(coded.dictionary.to_numpy())
            sums.append(np.bincount(coded.indices.to_numpy(), weights=got[at]))
            tokens, size, many = [], 0, many + len(rows[-1])
            give_back()

        def added():
            """The sums of all buckets so far, by blocks of documents."""
            nonlocal many
            row, value = _sum_equal(np.concatenate(rows), np.concatenate(sums))
            rows.clear(), sums.clear()
            many = 0
            block = row >> BLOCK
            ends = [*(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            parts = list(zip([0, *ends], ends))
            data = [[(row[a:b] & (1 << BLOCK) - 1).astype("<u2").tobytes() for a, b in parts], [value[a:b].astype("<f4").tobytes() for a, b in parts]]
            return pa.RecordBatch.from_arrays([pa.array([block[a] for a, _ in parts], pa.int64()), *(pa.array(x, pa.binary()) for x in data)], ["block", "at", "value"])

        for b in batches:
            for bucket, first, n, code, offset in _rows(b):
                if bucket != current:
                    if tokens:
                        flush()
                    current, table = bucket, None
                if first is None:
                    key, zero, one, _ = model.node_counts(*unpack_pairs(n, code, offset))
                    order = np.argsort(key)
                    table = key[order], pack(zero, one)[order]
                    continue
                tokens.append((np.cumsum(_expand(code, n, "<i8")), first + _expand(offset, n, "<i4").astype(np.int64)))
                size += n
                if size > LATER:
                    flush()
                if many > 2 * LATER:
                    yield added()
        if tokens:
            flush()
        if rows:
            yield added()

    pairs = word.pairs.where("g >= 0").select(F.col("g").alias("bucket"), F.lit(None).cast("long").alias("first"), "n", F.col("pair").alias("code"), F.col("c").alias("offset"))
    def total(table: pa.Table) -> pa.Table:
        block, out = table.column("block")[0].as_py(), np.zeros(1 << BLOCK)
        for at, value in zip(table.column("at"), table.column("value")):
            out[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(value.as_buffer(), "<f4")
        used = np.flatnonzero(out)
        return pa.table({"row": pa.array((block << BLOCK) + used), "later": pa.array(out[used])})

    both = pairs.unionByName(later).repartition(max(TASKS, word.buckets // BUCKETS_AT_ONCE), "bucket").sortWithinPartitions("bucket", F.col("first").isNotNull())
    return both.mapInArrow(run, "block long, at binary, value binary").groupBy("block").applyInArrow(total, "row long, later double")


def _after(model: WordModel, pair: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """log10 probability of pairs by the packed counts ``value`` of the contexts and nodes ``key`` (ordered)."""
    context, symbol = pair >> WIDTH, pair & MASK

    def first(index, node):
        wanted = context[index] * max(1, model.escape) + node
        if not len(key):
            return np.full(len(wanted), UNSEEN, np.uint16)
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.where(key[at] == wanted, value[at], np.uint16(UNSEEN))

    return model.score_pairs(context, symbol, first)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    ``base_score`` is the add-one unigram's log10 probability of the tokens, ``score`` the
    model's of the same tokens; ``bits_per_byte`` is the latter in bits over the text's
    UTF-8 bytes plus 1. Null text is empty (one token, the end). A null key counts as
    training; repeated rows are scored each; other columns are ignored. The documents' words
    must be in ``model.rare`` or have codes, as they do where the model was trained on a
    table that holds them, in either fold.
    """
    spark = docs.sparkSession
    ship_package(spark)
    word, norm = model.word, math.log10(model.word.tokens + model.word.types + 1)
    shared = spark.sparkContext.broadcast((word,))
    kind = docs.select(key).schema[0].dataType.simpleString()
    buckets = word.buckets
    fields = f"key_ {kind}, n_bytes long, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,n:int>>, row long, bucket long, n long, code binary, offset binary"
    names = [*"key_ n_bytes n_tokens n_known base score rare row bucket n code offset".split()]
    kinds: list[pa.DataType] = []

    def run(batches):
        (words,) = shared.value
        row = begin = TaskContext.get().partitionId() << 33
        base = np.append(np.log10(words.counts + 1.0) - norm, 0.0)
        held, size = [], 0

        def send():
            """The tokens gathered, ordered by bucket and pair; a row for every bucket."""
            every = np.sort(np.concatenate(held))
            doc, code = (every & ((1 << 22) - 1)).astype("<i4"), every >> 22
            bucket = (code >> WIDTH + 5) * buckets >> WIDTH
            code = _natural(code >> 5) << 5 | code & 31
            ends = [*(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            parts = list(zip([0, *ends], ends))
            data = [pa.array([_squeeze(np.diff(code[a:b], prepend=0)) for a, b in parts], pa.binary()), pa.array([_squeeze(doc[a:b]) for a, b in parts], pa.binary())]
            empty = [pa.nulls(len(parts), x) for x in kinds]
            return pa.RecordBatch.from_arrays([*empty, pa.array([begin] * len(parts), pa.int64()), pa.array([bucket[a] for a, _ in parts], pa.int64()), pa.array([b - a for a, b in parts], pa.int64()), *data], names)

        for piece, texts in slices(batches, "text_", SMALL_SLICE):
            if held and (size > LATER or row + len(texts) - begin >= 1 << 22):
                yield send()
                held, size, begin = [], 0, row
            t = Tokens(texts, words)
            per = lambda x, doc=t.doc: np.bincount(doc, weights=x, minlength=len(texts))  # noqa: B023, E731
            place, hold, run = words.matches(t)
            match = np.zeros(len(t.symbol), np.int64)
            match[place[hold]] = run[hold] + 1
            own_score = np.zeros(len(t.symbol))
            own_score[place[~hold]] = words.match_odds[1][run[~hold]]
            context = words.context(t)
            is_own = words.row[context] >= 0
            own, later = np.flatnonzero(is_own), np.flatnonzero(~is_own)
            got = words.score_own(context[own], t.symbol[own])
            hit = np.flatnonzero(match[own])
            got[hit] = words.with_match(got[hit], match[own[hit]] - 1)
            own_score[own] += got
            if len(later):
                pair = mixed_order(context[later]) << WIDTH | t.symbol[later]
                held.append((pair << 5 | match[later]) << 22 | t.doc[later] + (row - begin))
                size += len(later)
            coded = t.rare.dictionary_encode()
            many = max(1, len(coded.dictionary))
            pair, times = np.unique(t.rare_doc * many + coded.indices.to_numpy(), return_counts=True) if len(t.rare) else (np.empty(0, np.int64),) * 2
            owner, name = np.divmod(pair, many)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            struct = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(name)).cast(pa.string()), pa.array(times, pa.int32())], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
            known = (t.symbol != words.escape).astype(np.float64)
            columns = [piece.column(0), piece.column(1), pa.array(t.counts), pa.array(per(known).astype(np.int64)), pa.array(per(base[t.symbol])), pa.array(per(own_score)), rare, pa.array(row + np.arange(len(texts)))]
            kinds[:] = [x.type for x in columns[:-1]]
            empty = [pa.nulls(len(texts), k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *empty], names)
            row += len(texts)
        if held:
            yield send()

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key_"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text_"))
    both = materialise(rows.mapInArrow(run, fields), "scored")
    scored = both.where("bucket IS NULL").drop("bucket", "n", "code", "offset")
    later = _score_later(both.where("bucket IS NOT NULL").select("bucket", F.col("row").alias("first"), "n", "code", "offset"), word, shared)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(model.rare, "word")
    share, total = model.known_share, max(1, model.rare_tokens)
    mixed = F.log10(F.lit(share / total) * F.col("c") + (1 - share) * F.pow(F.lit(10.0), F.greatest(F.col("spelled"), F.lit(-290.0))))
    mixed = F.when((F.col("c") == 0) & (F.col("spelled") < -290), F.col("spelled") + math.log10(1 - share)).otherwise(mixed)
    of = rare.groupBy("row").agg(F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - norm)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * mixed).alias("rare_score"))
    out = scored.drop("rare").join(of, "row", "left").join(later, "row", "left").fillna(0, ["rare_base", "rare_known", "rare_score", "later"])
    total_score = F.col("score") + F.col("rare_score") + F.col("later")
    return out.select(
        F.col("key_").alias(key),
        held_out(F.col("key_")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(word.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"),
        total_score.alias("score"),
        (-total_score * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def score_corpus(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Train on the training fold of ``docs`` and score all of them.

    Null texts are empty and score their end alone. Null and repeated keys and repeated rows are
    scored, and trained on, row by row; other columns are ignored; an empty table gives an
    empty result.
    """
    return score(docs, train(docs, **options), **options)
