"""Token ids of whole texts by the rules of a tokenizers file, word by word with a cache.

For vocabularies whose pieces never cross a space or a line end, a text's ids are those of
its words one after another, and every word is encoded once in a process. Plain words go in
batches to tiktoken's byte-pair merger, fed with the file's own merges, and a share of them is
compared with the tokenizers library; all others go through the library's whole pipeline.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelworks.llm.common import WordCache, ragged

#: Every so many new plain words are also encoded by the library, and a difference raises.
CHECKED = 16
#: Words that a process keeps, about 50 bytes each: most of those that come a second time.
KEPT = 400_000
#: Ends a stretch inside the merger; plain words hold no control characters.
_END = "\x01"
#: Fixed value: the pre-tokenizer's stretches. In plain words they are runs of letters, single digits, and runs of other characters.
STRETCHES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Class of a byte of a plain word: letter (all beyond ASCII are), digit, line end, other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1
_CLASS[10] = 2


def merger(vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
    """(tiktoken encoding, id of each of its ranks or -1) that merges as the ranked pairs say.

    A stretch is its UTF-8 bytes and one end byte, which joins the last byte first (that is
    what the suffix stands for). Merging by the rank of the joined piece is the same as by
    the rank of the pair if no two pairs make one piece, which is checked.
    """
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    end = _END.encode()

    def raw(piece: str) -> bytes:
        whole = piece.endswith(suffix)
        return bytes(byte[c] for c in (piece[: -len(suffix)] if whole else piece)) + (end if whole else b"")

    # Single bytes, then bytes that end a stretch, then the merges in order.
    pieces = [bytes([b]) for b in range(256)] + [bytes([b]) + end for b in range(256)]
    names = {v: k for k, v in byte.items()}
    ids = [vocabulary.get(names[b], -1) for b in range(256)] + [vocabulary.get(names[b] + suffix, -1) for b in range(256)]
    for a, b in merges:
        pieces.append(raw(a) + raw(b))
        ids.append(vocabulary[a + b])
    ranks = {p: i for i, p in enumerate(pieces)}
    if len(ranks) != len(pieces):
        raise ValueError("two merges make the same piece")
    encoding = tiktoken.Encoding("merges", pat_str=rf"[^{_END}\n]+{_END}|\n", mergeable_ranks=ranks, special_tokens={})
    return encoding, np.array(ids, np.int32)


class WordTokenizer:
    """A tokenizer file whose pre-tokenizer drops white space and lower-cases."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache = WordCache(KEPT)
        spec = json.loads(self.library.to_str())
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("this tokenizer's words do not stand alone")
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger, self.id_of = merger(model["vocab"], merges, model["end_of_word_suffix"])
        #: What a plain word may hold: visible ASCII and letters up to U+024F, composed and with a lower case of one letter.
        #: (Without the apostrophe, with which some stretches begin, and the two signs among the letters.)
        self.plain = "^[!-&(-~À-ÖØ-öø-įı-ɏ]+$"
        if split["pattern"]["Regex"] != STRETCHES:
            raise ValueError("another pre-tokenizer than the one that is built in")

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of plain words: lower-cased, cut into stretches and merged, all in one go."""
        if not len(words):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        text = np.frombuffer("\n".join([*words.to_numpy(zero_copy_only=False), ""]).lower().encode(), np.uint8)
        kind = _CLASS[text]
        last = np.flatnonzero(((kind[:-1] != kind[1:]) | (kind[:-1] == 1)) & (kind[:-1] != 2))
        cut = np.insert(text, last + 1, ord(_END)).tobytes().decode()
        found = self.merger.encode_to_numpy(cut, disallowed_special=())
        line = found == 10  # the line end's rank
        return self.id_of[found[~line]], np.diff(np.flatnonzero(line), prepend=-1) - 1

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.and_(pc.match_substring_regex(words, self.plain), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        ids, lengths = self._plain(words.filter(pa.array(plain)))
        self._compare(words.filter(pa.array(plain)), ids, lengths)
        if plain.all():
            return ids, lengths
        odd = [x.ids for x in self.library.encode_batch(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        each = np.empty(len(words), np.int64)
        each[plain], each[~plain] = lengths, [len(x) for x in odd]
        out = np.empty(int(each.sum()), np.int32)
        of_plain = np.repeat(plain, each)
        out[of_plain] = ids
        out[~of_plain] = np.fromiter((i for x in odd for i in x), np.int32)
        return out, each

    def _compare(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Raise if a share of plain words has other ids in the library."""
        some = np.arange(0, len(words), CHECKED)
        if not len(some):
            return
        theirs = [x.ids for x in self.library.encode_batch(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)]
        own = ids[ragged((np.cumsum(lengths) - lengths)[some], lengths[some])]
        if [len(x) for x in theirs] != lengths[some].tolist() or [i for x in theirs for i in x] != own.tolist():
            raise RuntimeError("the merger and the tokenizers library disagree")

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of a null-free string array."""
        parts = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        code = parts.flatten().dictionary_encode()
        if not len(code):
            return np.empty(0, np.int32), np.zeros(len(text), np.int64)
        known, starts, lengths = self.cache.get(code.dictionary, self._encode)
        index = code.indices.to_numpy()
        each = lengths[index]
        ids = known[ragged(starts[index], each)]
        bound = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(counts)
        return ids, bound[ends] - bound[ends - counts]

    def encode_with_end(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with the id ``end`` after each text's ids."""
        ids, counts = self.encode(text)
        return np.insert(ids, np.cumsum(counts), end), counts + 1


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, kept for the process."""
    return WordTokenizer(path)
