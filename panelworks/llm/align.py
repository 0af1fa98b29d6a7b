"""Alignment of two tokenizers' tokens by the byte offsets at which both end.

The libraries encode in Arrow batches; the alignment is relational. Every different text is
aligned once: short runs of its tokens are exploded and a window adds up their lengths in
bytes, the tokens are exploded by the offsets at which they end, and an equi-join on text and
end offset gives the cuts. The tokens between two cuts are a group; the tokens that end at a
cut are linked. Counts of linked id pairs over the corpus are grouped once and joined to every
link.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.llm.common import WordCache, give_back, materialise, ragged, ship_package, slices, utf8_buffer

#: Pair counts are broadcast up to so many rows (16 bytes each, about 100 MB as a hash table), else shuffled.
BROADCAST_PAIRS = 2_000_000
#: Ids have at most 16 bits and travel as shorts of the same bits.
_ID = 16
#: Every so many new pieces of the byte-level tokenizer are also encoded by its library, and a difference raises.
CHECKED = 16
#: Text whose tokens one task sorts, about, and partitions at most (beyond these, tasks sort on disk).
PART_BYTES, MOST_PARTS = 3 << 19, 20_000
#: Tokens whose lengths are added up in one row before the window does, a power of two.
RUN = 8
#: Fixed value: the byte-level pre-tokenizer's stretches.
STRETCHES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut_pieces(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, number of pieces of each): cut at single spaces between visible characters of Latin-1.

    Both tokenizers always end a token before such a space, so the ids of a text are those of
    its pieces, each behind its space. Empty texts have no piece.
    """
    data, offsets = utf8_buffer(text)
    visible = (data > 32) & (data < 127)
    letter = data == 0xC3  # begins a letter from U+00C0 to U+00FF
    cut = data == 32
    cut[1:] &= visible[:-1] | np.append(False, letter[:-2] & (data[1:-1] >= 0x80)) if len(data) > 1 else False
    cut[:-1] &= visible[1:] | letter[1:]
    full = offsets[:-1] < offsets[1:]
    cut[offsets[:-1][full]] = False
    cut[offsets[1:][full] - 1] = False
    at = np.flatnonzero(cut)
    number = np.diff(np.searchsorted(at, offsets)) + full
    starts = np.sort(np.concatenate([offsets[:-1][full], at + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], at]))
    bound = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bound), pa.py_buffer(data[~cut])]), number


class _Side:
    """One tokenizer: ids of pieces of text that stand behind a space, and the bytes of every id.

    exact: whether the ids' bytes are always those of the text.
    """

    exact = False

    def __init__(self, entries: list[bytes]):
        if len(entries) > 1 << _ID:
            raise ValueError("ids must fit in 16 bits")
        self.length = np.fromiter(map(len, entries), np.int64, len(entries))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.cache = WordCache(300_000)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of different pieces, none for a piece whose tokens' bytes are not a space and the piece."""
        lists = self.encode(pieces.to_pylist())
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(count.sum()))
        if self.exact:
            return ids.astype(np.int32), count
        size = self.length[ids]
        joined = self.bytes[ragged(self.start[ids], size)]
        data, offsets = utf8_buffer(pieces.cast(pa.large_string()))
        wanted = np.insert(data, offsets[:-1], 32)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(count)]
        if not (np.array_equal(ends, offsets[1:] + np.arange(1, len(lists) + 1)) and np.array_equal(joined, wanted)):
            good = np.fromiter((b"".join(self.bytes[self.start[i] : self.start[i] + self.length[i]].tobytes() for i in x) == b" " + p.encode() for x, p in zip(lists, pieces.to_pylist())), np.bool_, len(lists))
            keep = np.repeat(good, count)
            ids, count = ids[keep], np.where(good, count, 0)
        return ids.astype(np.int32), count

    def ids(self, pieces: pa.DictionaryArray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as shorts, number of ids of each) from their pieces; none for a text with a piece that has none."""
        known, starts, lengths = self.cache.get(pieces.dictionary, self._fresh)
        index = pieces.indices.to_numpy()
        each = lengths[index]
        if not each.all():
            whole = np.bincount(np.repeat(np.arange(len(number)), number), each == 0, len(number)) == 0
            each = np.where(np.repeat(whole, number), each, 0)
        bound = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(number)])]
        return known[ragged(starts[index], each)].astype(np.uint16).view(np.int16), bound


class ByteLevel(_Side):
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text.

    Pieces go through tiktoken's merger, whose ranks are the file's ids; a share of them is
    compared with the library. As it merges the text's bytes, its ids always spell them.
    """

    exact = True

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        special = set(self.library.get_added_tokens_decoder())
        names = (self.library.id_to_token(i) for i in range(self.library.get_vocab_size()))
        entries = [b"" if i in special else bytes(byte[c] for c in name) for i, name in enumerate(names)]
        super().__init__(entries)
        self.merger = tiktoken.Encoding("pieces", pat_str=STRETCHES, mergeable_ranks={e: i for i, e in enumerate(entries) if e}, special_tokens={})

    def encode(self, pieces):
        given = [" " + p for p in pieces]
        ids = [self.merger.encode_ordinary(p) for p in given]
        if [x.ids for x in self.library.encode_batch(given[::CHECKED], add_special_tokens=False)] != ids[::CHECKED]:
            raise RuntimeError("the merger and the tokenizers library disagree")
        return ids


class Pieces(_Side):
    """A SentencePiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = sp.id_to_piece(list(range(sp.get_piece_size())))
        if any(re.search("[^▁]▁", n) for n in names):
            raise ValueError("pieces that go on past a space are not supported")
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        super().__init__([bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if special(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])

    def encode(self, pieces):
        return self.library.encode(pieces, num_threads=1)


@lru_cache(maxsize=4)
def side(path: str) -> _Side:
    """The tokenizer of a file, kept for the process."""
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def tokens_of(text: Column, a: str, b: str) -> Column:
    """struct (a, b) of array<short>: every text's ids in both tokenizers as shorts of the same 16 bits; empty if either does not spell it out."""

    @F.arrow_udf("a array<smallint>, b array<smallint>")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for _, part in slices([pa.RecordBatch.from_arrays([text], ["text"])], "text"):
            pieces, number = cut_pieces(part)
            pieces = pieces.dictionary_encode()
            lists = [pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids)) for ids, bound in (side(x).ids(pieces, number) for x in (a, b))]
            out.append(pa.StructArray.from_arrays(lists, ["a", "b"]))
        kind = pa.struct([("a", pa.list_(pa.int16())), ("b", pa.list_(pa.int16()))])
        return pa.chunked_array(out, kind).combine_chunks() if out else pa.array([], kind)

    return run(text)


KEY = ["k1", "k2"]


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _texts(docs: DataFrame, text: str, a: str, b: str) -> DataFrame:
    """(k1, k2, copies, a, b): ids of every different text. Texts are encoded where they are read; equal ones meet before and in the shuffle."""
    rows = docs.select(F.col(text).cast("string").alias("text")).where("text <> ''")
    rows = rows.select(*text_key(F.col("text")), tokens_of(F.col("text"), a, b).alias("ids")).select(*KEY, "ids.a", "ids.b")
    return rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("a").alias("a"), F.first("b").alias("b"))


def _ends(texts: DataFrame, ids: str, path: str, carried: Column) -> DataFrame:
    """(k1, k2, end, text): a row for each token of one side by its end offset; the last one has what is ``carried``.

    Lengths in bytes are added up within runs of RUN tokens, and a window adds up the runs before:
    far fewer rows than tokens go through the window and its sort.
    """
    # Lengths come as a broadcast row: a literal would be folded anew for each use and read by each task.
    kind = T.StructType([T.StructField("sizes", T.ArrayType(T.IntegerType(), False), False)])
    sizes = texts.sparkSession.createDataFrame([(side(path).length.tolist(),)], kind)
    runs = texts.crossJoin(F.broadcast(sizes)).select("*", F.explode(F.sequence(F.lit(0), F.size(ids) - 1, F.lit(RUN))).alias("at"))
    one = [F.get("sizes", F.get(ids, F.col("at").bitwiseOR(i)).cast("int").bitwiseAND((1 << _ID) - 1)) for i in range(RUN)]
    last = F.when(F.col("at") + RUN >= F.size(ids), carried)
    # Beyond the last token sums are null and match nothing.
    runs = runs.select(*KEY, "at", last.alias("text"), *[x.alias(f"s{i}") for i, x in enumerate(itertools.accumulate(one, lambda x, y: x + y))])
    runs = runs.withColumn("size", F.greatest(*[f"s{i}" for i in range(RUN)]))
    before = F.sum("size").over(W.partitionBy(*KEY).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    runs = runs.select("*", before.cast("int").alias("before"))
    tokens = runs.select(*KEY, "text", (F.col("before") + F.col("size")).alias("reached"), F.explode(F.array(*[F.col("before") + F.col(f"s{i}") for i in range(RUN)])).alias("end"))
    return tokens.select(*KEY, "end", F.when(F.col("end") == F.col("reached"), F.col("text")).alias("text"))


def align(docs: DataFrame, a: str, b: str, *, text: str = "text") -> DataFrame:
    """(k1, k2, copies, a, b, cuts) of every different text that both tokenizers spell out.

    a, b: all ids (:func:`tokens_of`). cuts: the offsets in bytes, in order, at which tokens of both end.
    Texts without tokens are left out.
    """
    # The condition asks for all columns, so that both sides of the join read one and the same shuffle.
    texts = _texts(docs, text, a, b).where("copies > 0 AND size(a) > 0 AND size(b) > 0")
    tokens = _ends(texts, "a", a, F.struct("copies", "a", "b"))
    others = _ends(texts, "b", b, F.lit(None)).select(*KEY, "end")
    # Sizes of exploded tokens are not known to the planner, so it is told not to broadcast them.
    cuts = tokens.hint("merge").join(others.hint("merge"), [*KEY, "end"], "left_semi")
    one = cuts.groupBy(*KEY).agg(F.collect_list("text")[0].alias("text"), F.sort_array(F.collect_list("end")).alias("cuts"))
    return one.where("text IS NOT NULL").select(*KEY, "text.*", "cuts")


class _Digits:
    """Decimal ids as rows of six bytes, each with room for what follows it, and which bytes are used."""

    def __init__(self, n: int):
        names = [b"%d," % i for i in range(n)]
        self.length = np.fromiter(map(len, names), np.int64, n)
        self.bytes = np.frombuffer(b"".join(x.ljust(6) for x in names), np.uint8).reshape(n, 6)
        self.used = np.arange(6) < self.length[:, None]


@lru_cache(maxsize=1)
def _digits() -> _Digits:
    return _Digits(1 << _ID)


@contextlib.contextmanager
def _by_text(spark: SparkSession, parts: int):
    """While this holds, shuffles have ``parts`` parts, and a join on text and offset keeps rows where their text is.

    Spark would join parts that are small as ids and split rows of a text by offset again; it
    cannot know how many rows the ids become. Arrow batches are short, as a text has many ids.
    Joined rows are in the order of texts, so they are grouped as they come: a hash table of
    texts would be given up after a few and its rows sorted again.
    """
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.windowExec.buffer.in.memory.threshold": "65536", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def described(aligned: DataFrame, a: str, b: str) -> DataFrame:
    """(k1, k2, copies, n_a, n_b, n_groups, groups_sha256, links) of aligned texts; links: an id pair (a above b) for every cut."""
    ship_package(aligned.sparkSession)

    def run(batches):
        digits = _digits()
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, copies, *lists, cuts = batch.columns
            count = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (*lists, cuts)]
            ids = [x.flatten().to_numpy().view(np.uint16).astype(np.int64) for x in lists]
            # Offsets over all texts of the batch; each ends with a cut, so the tokens between two cuts are a group.
            ends = [np.cumsum(side(path).length[x]) for path, x in zip((a, b), ids)]
            before = np.concatenate([[0], ends[0][np.cumsum(count[0]) - 1]])
            is_cut = np.zeros(before[-1] + 1, np.bool_)
            is_cut[cuts.flatten().to_numpy() + np.repeat(before[:-1], count[2])] = True
            last_a, last_b = (np.flatnonzero(is_cut[x]) for x in ends)
            in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
            # All texts' tokens in the order of the groups, A's before B's, and what follows each.
            total = np.concatenate([[0], np.cumsum(in_a + in_b)])
            at_a, at_b = ragged(total[:-1], in_a), ragged(total[:-1] + in_a, in_b)
            order = np.empty(int(total[-1]), np.int64)
            order[at_a], order[at_b] = ids[0], ids[1]
            text = digits.bytes[order][digits.used[order]]
            stop = np.cumsum(digits.length[order])
            text[stop[total[:-1] + in_a - 1] - 1] = ord("|")
            text[stop[total[1:] - 1] - 1] = ord(";")
            ends = np.concatenate([[0], stop])[total[np.cumsum(count[2])]].tolist()
            view, sha, start = memoryview(text), [], 0
            for end in ends:
                sha.append(hashlib.sha256(view[start : end - 1]).hexdigest())
                start = end
            pairs = ids[0][last_a] << _ID | ids[1][last_b]
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[2])]), pa.int32()), pa.array(pairs, pa.int64()))
            yield pa.RecordBatch.from_arrays([k1, k2, copies, pa.array(count[0]), pa.array(count[1]), pa.array(count[2]), pa.array(sha), links], ["k1", "k2", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
            give_back()

    rows = aligned.select(*KEY, "copies", "a", "b", "cuts")
    return rows.mapInArrow(run, "k1 long, k2 long, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair over the corpus, copies counted, and whether no pair of its B id has more."""
    counts = texts.select("copies", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count"))
    counts = materialise(counts, "pairs")
    of_b = F.col("pair").bitwiseAND((1 << _ID) - 1)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, of_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, a: str, b: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Null and empty texts, and texts that a tokenizer does not spell out byte by byte, have no
    tokens: zeros and an empty digest. Null and repeated keys and repeated rows stay and count
    by their texts; other columns are ignored, an empty table gives an empty result. A text of
    any length is aligned whole; tokens of one text are sorted on disk if they must be.
    """
    ship_package(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with _by_text(docs.sparkSession, max(least, min(-(-size // PART_BYTES), MOST_PARTS))):
        found = materialise(described(align(docs, a, b, text=text), a, b), "aligned")
    pairs = pair_counts(found)
    small = pairs.count() <= BROADCAST_PAIRS
    links = found.select(*KEY, F.explode("links").alias("pair")).join(F.broadcast(pairs) if small else pairs, "pair")
    sums = links.groupBy(*KEY).agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    each = found.select(*KEY, "n_a", "n_b", "n_groups", "groups_sha256").join(sums, KEY)
    rows = docs.select(F.col(key).alias("key_"), *text_key(F.col(text).cast("string")))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = rows.join(each, KEY, "left").select(F.col("key_").alias(key), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return out
