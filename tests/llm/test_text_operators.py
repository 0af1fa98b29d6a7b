"""The text operators against plain re-computation, on odd rows of every kind."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelworks.llm import common, lm, neardup, ogg, packing, repair, repetition, sharding, spm, tokens, toxicity, urlfilter
from panelworks.llm.queries import QUERIES, URL_RULES, vocabulary_file

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECES, TOKENS = vocabulary_file("piece_bpe_32k.model"), vocabulary_file("word_bpe_49k.json")


def taken(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENS)


# Sharding


def test_shards(docs, rows):
    got = sharding.assign(docs, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    of_key, slots = defaultdict(set), defaultdict(list)
    for r in got:
        of_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(len(x) == 1 for x in of_key.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_follow_weights_and_move_little(spark):
    keys = spark.range(4000).withColumn("w", sharding.shard_of(F.col("id"), [1.0, 1.0, 2.0])).withColumn("g", sharding.shard_of(F.col("id"), [1.0, 1.0, 2.0, 4.0]))
    n = Counter(r["w"] for r in keys.collect())
    assert abs(n[2] - 2000) < 200 and abs(n[0] - 1000) < 150
    moved = [(r["w"], r["g"]) for r in keys.collect() if r["w"] != r["g"]]
    assert all(g == 3 for _, g in moved) and abs(len(moved) - 2000) < 200


def test_shards_written(spark, docs, rows, tmp_path):
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


# SentencePiece


def test_encoding_equals_library(docs, rows):
    sp = spm.vocabulary(PIECES).library
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in spm.encode(docs, PIECES).collect())
    assert got == Counter((k, tuple(sp.encode(t or ""))) for k, t in rows)
    trip = taken(spm.round_trip(docs, PIECES), "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for _, t in rows:
        ids = sp.encode(t or "")
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert trip == sorted(want, key=repr)


def test_encoding_of_random_texts():
    vocab = spm.vocabulary(PIECES)
    r = random.Random(5)
    alphabet = "ab c▁ \n\n  .é日😀the ing\x00<>\t"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)]
    ids, counts = spm.encode_texts(pa.array(texts), vocab)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == vocab.library.encode(texts)


def test_encoding_of_long_texts_without_spaces():
    """A million characters without a cut take seconds, and odd runs are joined in the library's order."""
    vocab = spm.vocabulary(PIECES)
    r = random.Random(7)
    long = "".join(r.choices("etaoinshrdluETAöé日", k=1_000_000))
    began = time.process_time()
    ids, _ = spm.encode_texts(pa.array([long]), vocab, check=False)
    assert time.process_time() - began < 15  # about 2 on an idle core
    assert ids.tolist() == vocab.library.encode(long)
    odd = ["a" * 3001, "the" * 700, "abab" * 500 + "ba" * 300, "".join(r.choices("ab", k=2000)), "日" * 400 + "x" * 400]
    ids, counts = spm.encode_texts(pa.array(odd), vocab, check=False)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == vocab.library.encode(odd)


# Tokens, files, packing


def test_tokens_equal_library(rows):
    own, lib = tokens.tokenizer(TOKENS), library()
    r = random.Random(9)
    alphabet = "ab'stre C.É ß \n\t😀日İΣſ<|>endoftext1½\x85"
    texts = [t or "" for _, t in rows] + ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(400)]
    ids, counts = own.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_id_files(docs, rows):
    lib = library()
    got = repair.write_and_read(docs, TOKENS).collect()
    at = 0
    of = defaultdict(list)
    for k, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        of[k].append((len(ids), crc(ids)))
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        of[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    assert not any(of.values())
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys)


def test_plain_words_merge_as_the_library_says():
    """All plain words' stretches, over the whole vocabulary and random strings."""
    own, lib = tokens.tokenizer(TOKENS), library()
    r = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzäöüßéèñ0123456789.,;:!?#*$%&|-_()\"/ABCÀÉ×'"
    words = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 14))) for _ in range(5000)]
    words += [w.replace("</w>", "") for w in list(lib.get_vocab())[::9] if "<|" not in w and w.isascii()]
    words = [w for w in words if w.strip()]
    ids, lengths = own._encode(pa.array(words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [x.ids for x in lib.encode_batch(words, add_special_tokens=False)]


def test_word_cache_gives_the_same_when_full():
    own, small = tokens.tokenizer(TOKENS), tokens.WordTokenizer(TOKENS)
    small.cache.limit = 5
    for text in (["a bb ccc", "dd ee"], ["ff gg hh a bb"], ["new words come again and again", "a"], [""]):
        for x, y in zip(own.encode(pa.array(text)), small.encode(pa.array(text)), strict=True):
            assert np.array_equal(x, y)
    assert len(small.cache.words) <= 5


def plain_pairs(s):
    return Counter(zip(s, s[1:]))


def test_grammar_leaves_no_pair_that_would_shorten_the_file():
    r = np.random.default_rng(8)
    ids = np.concatenate([np.tile(r.integers(0, 40, 30), 40), r.integers(0, 12, 3000), np.full(333, 5)]).astype(np.int32)
    s, _, rules = repair.compress(ids, np.zeros(len(ids), int), 100)
    left = plain_pairs(s.tolist())
    # Overlapping occurrences (aaa) count once for every two.
    assert max((n for (a, b), n in left.items() if a != b), default=0) < repair.LEAST
    assert len({tuple(x) for x in rules.tolist()}) == len(rules)
    used = Counter(s.tolist()) + Counter(rules.ravel().tolist())
    assert all(used[100 + i] for i in range(len(rules)))


def test_damaged_shards_raise():
    data = repair.to_bytes(np.arange(50, dtype=np.int32) % 7, np.array([20, 0, 30]), 49408)
    assert repair.Shard(data).document(1).tolist() == []
    for at in (0, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            repair.Shard(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        repair.Shard(data[:10])


def test_files_with_several_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 300)
    sizes = [len(library().encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    got = repair.write_and_read(docs, TOKENS).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(sizes)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_grammar_decodes_any_part():
    r = np.random.default_rng(3)
    ids = np.concatenate([r.integers(0, 30, 4000), np.tile(r.integers(0, 200, 50), 60), np.full(500, 7)]).astype(np.int32)
    counts = np.array([1, 999, 3000, 0, len(ids) - 4000])
    block = repair.Shard(repair.to_bytes(ids, counts, 49408))
    assert np.array_equal(block.all(), ids) and len(block.rules) > 20 and len(block.symbols) < len(ids) * 0.6
    assert np.array_equal(block.lengths, repair.expansion_lengths(block.rules, 49408))
    ends = np.cumsum(counts)
    for i, (e, n) in enumerate(zip(ends, counts)):
        assert np.array_equal(block.document(i), ids[e - n : e])
    for a, b in r.integers(0, len(ids) + 1, (200, 2)):
        if a <= b:
            assert np.array_equal(block.range(int(a), int(b)), ids[a:b])
    with pytest.raises(IndexError):
        block.range(0, len(ids) + 1)


def test_packing(docs, rows):
    lib = library()
    got = packing.pack(docs, TOKENS).collect()
    want = Counter()
    for k, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for i, a in enumerate(range(0, len(ids), 4096)):
            want[k, i, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    of = defaultdict(list)
    for r in got:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in of.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    histogram = np.bincount([r["length"] for r in got], minlength=4097)
    assert len(of) <= packing.lower_bound(histogram, 4096) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_tight(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(r.lognormal(4 + seed * 0.5, 1, 20_000).astype(int) + 1, 512)
    h = np.bincount(lengths, minlength=513)
    made = packing.plan(h, 512)
    back = np.zeros(513, int)
    for pattern, n in made:
        assert sum(pattern) <= 512 and n > 0
        for v in pattern:
            back[v] += n
    assert np.array_equal(back, h)
    assert sum(n for _, n in made) <= packing.lower_bound(h, 512) * 1.01 + 1
    assert packing.plan(np.zeros(513, int), 512) == []


def test_most_tokens_go_by_fitted_patterns():
    """At several sizes of one length distribution, and no repeat takes more than there is."""
    r = np.random.default_rng(6)
    lengths = np.minimum(r.lognormal(6.2, 0.9, 8000).astype(int) + 1, 4095)
    for times in (1, 40):
        h = np.bincount(lengths, minlength=4097) * times
        made = packing.fitted_patterns(h, 4096)
        used = np.zeros(4097, int)
        for p, n in made:
            assert 2 <= len(p) <= 7 and sum(p) == 4096
            for v in p:
                used[v] += n
        assert (used <= h).all()
        assert (used * np.arange(4097)).sum() >= 0.8 * (h * np.arange(4097)).sum()


def test_fit_lowers_the_squared_error():
    h = np.zeros(11, int)
    h[[3, 4, 6, 7]] = 30, 20, 20, 30
    chosen = packing.patterns(h, 10)
    assert set(chosen) >= {(7, 3), (6, 4), (4, 3, 3)}
    x = packing.fit(h, chosen)
    rest = h.astype(float)
    for n, p in zip(x, chosen):
        for v in p:
            rest[v] -= n
    assert (x >= 0).all() and (rest**2).sum() < 1
    assert sum(n for _, n in packing.round_counts(h, chosen, x)) > 45


# Media


def test_media(docs, rows):
    got = ogg.decode(ogg.encode(docs), keep_samples=True).collect()
    want = Counter()
    for k, t in rows:
        raw = (t or "").encode()
        want[k, len(raw), ogg.pad64(raw)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["samples"])) for r in got) == want
    for r in got:
        data = bytes(r["samples"])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert len(data) >= 64 and len(data) % 64 == 0
    assert len({r["media_sha256"] for r in got}) == len({r["payload_sha256"] for r in got})


def test_times_of_packets_come_from_positions():
    samples = bytes(range(256)) * 200
    media = ogg.encode_samples(samples)
    back, facts = ogg.decode_samples(media)
    assert back == samples
    ends = {0: [], 1: []}
    for k, at in enumerate(range(0, len(samples), ogg.PACKET)):
        own = ends[k // ogg.TURN % 2]
        own.append((own[-1] if own else 0) + len(samples[at : at + ogg.PACKET]) / ogg.RATE)
    assert {i: pytest.approx(t) for i, t in ends.items()} == facts["times"]


def test_equal_rows_are_numbered_in_several_buckets(spark):
    rows = spark.createDataFrame([(None, None)] * 500 + [(1, "a")] * 300, "doc_id long, text string").repartition(4)
    got = sharding.assign(rows, 8).collect()
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_words_that_the_merger_gets_wrong_raise():
    t = tokens.WordTokenizer(TOKENS)
    t.id_of = t.id_of + 1
    with pytest.raises(RuntimeError, match="disagree"):
        t.encode(pa.array(["plain words here"]))


def slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


def test_pages_and_packets():
    assert all(slow_crc(x) == ogg.page_crc(x) for x in (b"", b"a", b"OggS" * 20, bytes(range(256))))
    big = bytes(range(256)) * 600
    packets = [(7, 0, b"head"), (9, 0, b""), (7, 500, big), (9, 255, b"z" * 255), (7, 510, b"end")]
    media = ogg.mux(packets)
    streams = ogg.demux(media)
    assert [p for _, p in streams[7]] == [b"head", big, b"end"] and [p for _, p in streams[9]] == [b"", b"z" * 255]
    assert [g for g, _ in streams[7]] == [0, 500, 510]
    for at in (4, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.demux(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        ogg.demux(media[:-10])


def test_packets_share_pages_and_positions_are_derived():
    packets = [(5, 0, b"head"), *[(5, 100 * (i + 1), bytes([i % 256]) * 100) for i in range(600)], (5, 60_050, b"y" * 100)]
    media = ogg.mux(packets)
    pages = list(ogg.pages_of(media))
    assert len(pages) == 1 + 3 and [len(x[4]) for x in pages] == [1, 255, 255, 91]
    got = ogg.demux(media)[5]
    assert [d for _, d in got] == [d for _, _, d in packets]
    assert sum(g >= 0 for g, _ in got) == 4  # one for every page
    # All are derived, and the last packet is cut short by the last position.
    assert ogg.positions([(0, b""), *got[1:]], len) == [g for _, g, _ in packets]
    # A stream cut out of the middle: the first page's position tells those before.
    assert ogg.positions([(-1, b"abc"), (-1, b"d"), (90, b"ef"), (-1, b"g"), (93, b"hi")], len) == [87, 88, 90, 91, 93]


def test_positions_refuse_gaps():
    good = [(0, b""), (-1, b"ab"), (5, b"cde"), (9, b"wxyz")]
    assert ogg.positions(good, len) == [0, 2, 5, 9]
    for bad in ([(0, b""), (-1, b"ab"), (6, b"cde"), (10, b"wxyz")], [(0, b""), (2, b"ab"), (1, b"cde")]):
        with pytest.raises(ValueError):
            ogg.positions(bad, len)


@pytest.mark.parametrize("size", [64, 16384, 16384 + 64, 40_000, 300_032])
def test_samples_of_every_size(size):
    samples = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    media = ogg.encode_samples(samples)
    back, facts = ogg.decode_samples(media)
    assert back == samples and facts["packets"] == -(-size // ogg.PACKET)
    counts = [0] * ogg.STREAMS
    for k in range(facts["packets"]):
        i = k // ogg.TURN % ogg.STREAMS
        before = counts[i] // ogg.PACKET
        counts[i] += len(samples[k * ogg.PACKET : (k + 1) * ogg.PACKET])
        assert facts["times"][i][before] == counts[i] / ogg.RATE
    if size > ogg.PACKET * ogg.TURN:
        assert facts["pages"] < facts["packets"]  # packets share pages


# Quality rules


def brute_rules(t):
    w = WORDS.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, lines = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            lines += line in seen
            seen.add(line)
    chars = sum(map(len, w))
    cover = []
    for n, _ in repetition.Rules().coverage:
        seen, hit = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                hit |= set(range(i, i + n))
            seen.add(g)
        cover.append(round(sum(len(w[i]) for i in hit) / max(1, chars), 9))
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), lines, len(marked), *cover)


def test_rules(docs, rows):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"coverage_{n}" for n, _ in repetition.Rules().coverage)]
    got = repetition.assess(docs).collect()
    assert Counter((r["doc_id"], *(round(r[n], 9) for n in names)) for r in got) == Counter((k, *brute_rules(t or "")) for k, t in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    kept = repetition.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_rules_reject_repeated_lines(spark):
    text = "\n".join(["these are the very same words in every one of the lines here"] * 3 + [" ".join(f"w{i}" for i in range(60))])
    r = repetition.assess(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not r["base_failed"] and not r["kept"] and r["n_dup_lines"] == 2


# Near-duplicates


def shingles(t):
    w = WORDS.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    parent = {k: k for k, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return Counter((k, len(shingles(t)), None if k is None else root(k), k is None or root(k) == k) for k, t in rows)


def test_near_duplicates(docs, rows):
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_components(rows)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (1, 2, 3)) == [1]


def test_near_duplicates_of_a_chain_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 16)
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):  # near copies of varied distance, in several blocks
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(100 + i, " ".join(chain[i * 5 : i * 5 + 100])) for i in range(40)]
    passage = [f"p{i}" for i in range(60)]
    rows += [(200 + i, " ".join(passage + [f"q{i}_{j}" for j in range(40)])) for i in range(40)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got) == brute_components(rows)


def test_collisions_lose_next_to_no_pair_at_the_limit():
    """Signatures of 3,000 pairs of sets whose similarity is 0.75 to 0.80, against T; and the binomial tail at 0.75."""
    from math import comb

    r = np.random.default_rng(11)
    found = n = 0
    for _ in range(30):
        sets, pairs = [], []
        for i in range(100):
            union = np.unique(r.integers(0, 1 << 63, 200 + 3 * i).astype(np.uint64))
            shared = int(np.ceil(len(union) * r.uniform(0.75, 0.80)))
            mixed = r.permutation(union)
            own = shared + (len(union) - shared) // 2
            a, b = np.sort(mixed[:own]), np.sort(np.concatenate([mixed[:shared], mixed[own:]]))
            assert 0.75 <= len(np.intersect1d(a, b)) / len(union) <= 0.81
            pairs.append((len(sets), len(sets) + 1))
            sets += [a, b]
        sig = neardup.signatures(sets)
        found += sum((sig[i] == sig[j]).sum() >= neardup.T for i, j in pairs)
        n += len(pairs)
    assert found / n >= 0.999
    assert sum(comb(neardup.K, k) * 0.75**k * 0.25 ** (neardup.K - k) for k in range(neardup.T)) < 1e-6


def test_components_without_edges_and_with_nulls(spark):
    edges = spark.createDataFrame([(b"a", None), (None, b"b"), (b"c", b"c"), (b"d", b"e"), (b"e", b"d")], "a binary, b binary")
    assert {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(edges).collect()} == {b"d": b"d", b"e": b"d"}
    assert neardup.components(edges.limit(0)).count() == 0


def plain_ftrl(rows, alpha=2.0, beta=1.0, l1=4.0, epochs=10):
    """FTRL-proximal with a dictionary, feature by feature."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f != "bias" and abs(z[f]) <= l1:
            return 0.0
        shrunk = abs(z[f]) - (0 if f == "bias" else l1)
        return -np.sign(z[f]) * shrunk / ((beta + np.sqrt(n[f])) / alpha)

    for _ in range(epochs):
        for label, present in rows:
            own = [*present.tolist(), "bias"]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + np.exp(-min(max(sum(w.values()), -35), 35))) - label
            for f in own:
                sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if weight(f)}


def test_ftrl_against_a_plain_loop():
    r = np.random.default_rng(12)
    rows = [(int(i % 3 == 0), np.unique([*r.integers(0, 60, 8).tolist(), *[70 + i % 3] * (i % 5 > 0)])) for i in range(80)]
    want = plain_ftrl(rows)
    got = toxicity.fit_ftrl(rows)
    assert got.bias == pytest.approx(want.pop("bias"))
    assert dict(zip(got.index.tolist(), got.value.tolist())) == pytest.approx(want) and len(want) > 1


def test_intersections_both_ways():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, 100).astype(np.uint64)) for _ in range(60)]
    pairs = tuple(x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30)))
    many = neardup._intersections(sets[:30], sets[30:], pairs)
    assert many.tolist() == [len(np.intersect1d(sets[i], sets[30 + j])) for i, j in zip(*pairs)]


def test_components_of_a_long_path(spark):
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(60)] + [(name(100), name(101))], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in neardup.components(edges).collect()}
    assert len({roots[name(i)] for i in range(61)}) == 1 and roots[name(100)] == roots[name(101)] != roots[name(0)]


# Toxicity


def test_toxicity_learns_words(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{r.randrange(300)}" for _ in range(60)] + ([r.choice(["vile", "nasty"]) for _ in range(3)] if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int"))
    assert 0 < len(model.index) < 2000
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in held]) > 0.97
    assert got[1000] == got[1001] and 0 < got[1000] < 0.7


def test_toxicity_without_labels(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5}


# URLs


def plain_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [None, "", "no scheme", "http://A.Example.ORG/en/12?q#f", "https://example.org/es/x", "https://example.org", "http://notorg/", "http://x.com/fr/1", "http://x.com/de/2?x=1", "http://x.net/a", "http://x.com?y=/fr/", "a://b://c.org/d", "http://É.org/\nx", "http://example.org/es"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, *URLS])] + [(None, "http://x.org/", "h")], "page_id long, url string, host string")
    model = urlfilter.train(urlfilter.labelled_by(pages))
    got = urlfilter.judge(pages, URL_RULES, model).collect()
    assert len(got) == 2 * len(URLS) + 1
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain_rule(URLS[r["page_id"] % len(URLS)])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == (verdict or ("block" if r["block_probability"] >= 0.5 else "allow"))


def plain_features(url):
    host, path, _, _ = plain_rule(url)
    url = url or ""
    query = url.split("://", 1)[1].split("#")[0].partition("?")[2] if "://" in url else ""

    def entropy(t):
        raw = t.encode()
        return -sum(c / len(raw) * np.log2(c / len(raw)) for c in Counter(raw).values()) if raw else 0.0

    digits = lambda t: sum(c in "0123456789" for c in t) / max(1, len(t))
    return [len(url), len(host), len(path), len([x for x in path.split("/") if x]), host.count(".") + bool(host), digits(url), digits(host), entropy(url), entropy(host), len([x for x in query.split("&") if x]), host.count("-")]


def columns_of(spark, urls):
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").coalesce(1).select("i", *urlfilter.parts(F.col("url"))).toArrow().sort_by("i")
    return [table.column(n).combine_chunks() for n in urlfilter.PARTS]


def test_url_features(spark):
    urls = [*URLS, "https://a.b-c.Exämple.com/x//y/é/?a=1&&b=2?c#d?e", "ftp://1.2.3.4:80/9"]
    assert np.allclose(urlfilter.lexical(columns_of(spark, urls)), [plain_features(u) for u in urls])


def fitted(spark, rows):
    columns = columns_of(spark, [u for u, _ in rows])
    return urlfilter.fit(urlfilter.lexical(columns), columns[4].to_numpy(), np.array([y for _, y in rows], float))


def test_trees_separate_and_handle_one_class(spark):
    r = random.Random(1)
    rows = [(f"http://a{r.randrange(99)}.net/{'9' * r.randrange(8, 30)}?a=1&b=2", 1) for _ in range(200)] + [(f"https://word{r.choice('xyz')}.org/news/{r.choice(['a', 'bb'])}", 0) for _ in range(200)]
    r.shuffle(rows)
    p = fitted(spark, rows[:300]).block_probability(columns_of(spark, [u for u, _ in rows[300:]]))
    assert np.mean((p > 0.5) == np.array([y for _, y in rows[300:]])) > 0.98
    nothing = urlfilter.fit(np.empty((0, 11)), np.empty(0, np.int64), np.empty(0))
    assert nothing.block_probability(columns_of(spark, ["x"]))[0] == 0.5
    assert fitted(spark, [("http://x.org", 0)] * 5).block_probability(columns_of(spark, ["x"]))[0] < 0.5


def test_first_split_is_the_best_of_all():
    """The root of a tree against trying every cut of every feature."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(200) < 0.1)).astype(float)
    trees = urlfilter.Trees(trees=1, depth=1).fit(x, y)
    p = (y.sum() + 0.5) / 201
    g, h = p - y, np.full(200, p * (1 - p))
    gain = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1) + g[~at].sum() ** 2 / (h[~at].sum() + 1)
    best = max((gain(x[:, f] <= c), f, c) for f in range(3) for c in np.unique(x[:, f])[:-1])
    root = trees.nodes[0][0]
    assert root[0] == best[1] == 1 and gain(x[:, root[0]] <= root[1]) == pytest.approx(best[0])


def test_suffix_rate_leaves_the_own_label_out(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(urlfilter.Trees, "fit", lambda self, x, y: seen.update(x=x) or self)
    urlfilter.fit(np.zeros((4, 11)), np.array([1, 1, 1, 2]), np.array([1.0, 0, 0, 1]))
    s, o = urlfilter.SMOOTHING, 0.5
    assert np.allclose(seen["x"][:, 11], [(0 + s * o) / (2 + s), (1 + s * o) / (2 + s), (1 + s * o) / (2 + s), o])


def test_ordinary_urls_pass_and_listed_ones_are_blocked(spark):
    """Fitted on four fifths of the pages, judged on the rest, without rules."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    fold = F.pmod(F.crc32(F.encode("url", "UTF-8")), F.lit(5))
    model = urlfilter.train(urlfilter.labelled_by(pages.where(fold != 0)))
    held = pages.where(fold == 0)
    label = urlfilter.labelled_by(held).distinct()
    got = urlfilter.judge(held, URL_RULES, model).where("rule IS NULL").join(held.select("page_id", "url"), "page_id").join(label, "url").collect()
    ordinary, listed = ([r["verdict"] == "block" for r in got if r["label"] == y] for y in (0, 1))
    assert len(ordinary) > 200 and np.mean(ordinary) < 0.05
    assert len(listed) >= 5 and np.mean(listed) > 0.8


# LM


def test_lm_base_and_totals(docs, rows):
    got = lm.score_corpus(docs.sparkSession, docs).collect()
    words = [(k, [*WORDS.findall((t or "").translate(LOWER)), "\n"]) for k, t in rows]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(w for k, ws in words if not held(k) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((k, held(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, ws in words)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in got)


def test_lm_beats_the_unigram(spark):
    r = random.Random(3)
    languages = [[f"{p}{i}" for i in range(200)] for p in "abc"]
    rows = [(i, " ".join(r.choices(languages[i % 3], weights=[1 / (j + 1) for j in range(200)], k=80))) for i in range(500)]
    got = lm.score_corpus(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert len(got) > 30
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got) * 0.9


def test_codes_are_prefix_free():
    code = lm.Code(np.array([5, 1, 1, 7, 3, 40]))
    bits = ["".join(map(str, code.bit[s : s + n])) for s, n in zip(code.start, code.length)]
    assert len(set(bits)) == 6 and not any(a != b and b.startswith(a) for a in bits for b in bits)
    assert sum(2.0 ** -len(b) for b in bits) == 1


def test_spelling_probabilities_sum_below_one():
    m = lm.SpellingModel(np.bincount(np.frombuffer(b"ab ab ba ", np.uint8), minlength=256))
    tables = np.zeros((lm.ORDERS, 1 << lm.BITS, 2), np.int64)
    words = pa.array(["ab", "ba", "abab"])
    m.gather(words, tables)
    m.tables = lm.pack(tables[:, :, 0], tables[:, :, 1])
    learner = m.learner()
    m.learn(learner, words)
    m.mixer = learner.result(learner.sums())
    every = ["".join(x) for n in (1, 2, 3) for x in __import__("itertools").product("abcd", repeat=n)]
    p = 10 ** m.score(pa.array(every))
    assert 0 < p.sum() < 1 and p[every.index("ab")] > p[every.index("cd")]


# All


@pytest.mark.parametrize(
    "f",
    [
        lambda d: sharding.assign(d), lambda d: spm.encode(d, PIECES), lambda d: spm.round_trip(d, PIECES), lambda d: repair.write_and_read(d, TOKENS), lambda d: packing.pack(d, TOKENS), lambda d: ogg.decode(ogg.encode(d)),
        lambda d: urlfilter.judge(d.withColumnRenamed("text", "url"), URL_RULES, urlfilter.train(urlfilter.labelled_by(d, url="text")), key="doc_id"), lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", F.col("shard").alias("toxic")))),
        repetition.assess, repetition.keep, neardup.near_duplicates, neardup.keep_one, lambda d: toxicity.score(d, toxicity.Model(0.0, np.array([1]), np.array([1.0]))), lambda d: lm.score(d, lm.train(d)),
    ],
)
def test_empty_tables(no_docs, f):
    assert f(no_docs).collect() == []


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i % 7) * 100 if i % 5 else None for i in range(50)])], ["k", "t"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), "t", 1000))
    assert [k for p, _ in parts for k in p.column(0).to_pylist()] == list(range(50)) and len(parts) > 5
    assert all(t.null_count == 0 for _, t in parts)


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_each_of_350_000_words_is_encoded_once(monkeypatch):
    own, fresh = tokens.WordTokenizer(TOKENS), []
    inner = own._encode
    monkeypatch.setattr(own, "_encode", lambda words: fresh.append(len(words)) or inner(words))
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(350_000)]
    texts = pa.array([" ".join(words[k : k + 5_000]) for k in range(0, len(words), 5_000)])
    first = [own.encode(texts.slice(k, 10)) for k in range(0, len(texts), 10)]
    again = [own.encode(texts.slice(k, 10)) for k in range(0, len(texts), 10)]
    assert sum(fresh) == len(words)
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(first, again))
