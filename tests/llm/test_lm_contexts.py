"""The LM operator against plain counting and plain recomputation of single documents."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from panelworks.llm import lm


def packed(zero, one):
    s = round(min(max(math.log((one + 0.4) / (zero + 0.4)), -20), 20) * 400)
    return s / 400, int(min(math.log2(zero + one + 1) / 3, 3))


def bit_probability(mixer, inputs, gate, row, bit):
    s = sum(w * x for w, x in zip(mixer.weights[gate], [*inputs, 1.0], strict=True))
    s = min(max(s, -16), 16)
    place = min(max(s, -7.99), 7.99) * 2 + 16
    low = int(place)
    refined = mixer.table[row, low] + (place - low) * (mixer.table[row, low + 1] - mixer.table[row, low])
    p = (1 / (1 + math.exp(-s)) + refined) / 2
    return p if bit else 1 - p


def test_scores_equal_plain_recomputation(spark):
    """Every document's score is that of counts kept in dictionaries, mixed bit by bit."""
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(700)]
    share = 1 / np.arange(3, 703)
    rows = [(i, " ".join(rng.choice(names, 150, p=share / share.sum()))) for i in range(120)] + [(120, ""), (121, "w5 unseen w6 w600 w601 w600 w601 w600")]
    rows += [(122, " ".join(["w3 w9 w400"] * 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.train(docs)
    got = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    word = model.word
    training = {r["doc_id"] for r in got.values() if not r["held_out"]}
    assert len(word.words) > lm.FREQUENT and 0 < len(training) < len(rows)
    index = {w: i for i, w in enumerate(word.words.to_pylist())}
    symbols = {i: [*(index.get(w, word.escape) for w in text.split()), index[lm.END]] for i, text in rows}

    pairs, odds = Counter(), defaultdict(lambda: [0, 0])

    def walk(i):
        """(context, symbol, run of the match or None, whether it holds) of every token."""
        before, seen, run = word.none, {}, 0
        s = symbols[i]
        for j, x in enumerate(s):
            match = seen.get((s[j - 2], s[j - 1])) if j >= 2 else None
            yield before, x, None if match is None else min(run, lm.RUNS - 1), match == x
            run = run + 1 if match == x else 0
            if j >= 2:
                seen[s[j - 2], s[j - 1]] = x
            before = x

    for i in training:
        for context, x, run, holds in walk(i):
            pairs[context, x] += 1
            if run is not None:
                odds[run][not holds] += 1
    counted = [lm.unpack_pairs(r["n"], r["pair"], r["c"]) for r in word.pairs.collect()]
    assert {(p >> lm.WIDTH, p & lm.MASK): c for pair, n in counted for p, c in zip(pair.tolist(), n.tolist(), strict=True)} == pairs
    for run in range(lm.RUNS):
        hold, fail = odds[run]
        assert np.allclose(10 ** word.match_odds[:, run], [(hold + 0.5) / (hold + fail + 1), (fail + 0.5) / (hold + fail + 1)])

    best = defaultdict(lambda: (0, 0, lm.CLASSES))
    for (context, x), c in pairs.items():
        if x < lm.CLASSES:
            best[context] = max(best[context], (c, -x, x))
    class_of = lambda context: best[context][2]
    own, classes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    code = lambda x: [(int(word.code.node[k]), int(word.code.bit[k])) for k in range(word.code.start[x], word.code.start[x] + word.code.length[x])]
    for (context, x), c in pairs.items():
        for node, bit in code(x):
            own[context, node][bit] += c
            if class_of(context) < lm.CLASSES:
                classes[class_of(context), node][bit] += c

    late = 0
    for i, text in rows:
        if i == 121 or any(x == word.escape for x in symbols[i]):
            continue
        total = 0.0
        for context, x, run, holds in walk(i):
            late += word.row[context] < 0
            p = 1.0
            for depth, (node, bit) in enumerate(code(x)):
                first, second = packed(*own[context, node]), packed(*classes[class_of(context), node])
                inputs = [first[0], second[0]]
                p *= bit_probability(word.mixer, inputs, first[1] * 4 + second[1], min(depth, lm.DEPTHS - 1), bit)
            if run is not None:
                hold, fail = 10 ** word.match_odds[:, run]
                p = hold + fail * p if holds else fail * p
            total += math.log10(p)
        assert abs(got[i]["score"] - total) < 1e-3 * abs(total) + 1e-3, i
        assert abs(got[i]["bits_per_byte"] + got[i]["score"] * math.log2(10) / (len(text.encode()) + 1)) < 1e-9
    assert late > 100
    # The repeated words are foretold by the match.
    assert got[122]["score"] > got[122]["base_score"] / 2


def test_online_newton_steps_come_near_the_best_weights():
    """One pass over blocks, in two learners that are summed, against plain Newton iterations on all bits."""
    rng = np.random.default_rng(3)
    n = 60_000
    x, gate = rng.normal(0, 2, (n, 2)), rng.integers(0, 2, n)
    true = np.array([[0.9, 0.1, 0.2], [0.3, 0.6, -0.4]])
    p = 1 / (1 + np.exp(-(x * true[gate, :2]).sum(1) - true[gate, 2]))
    bit = (rng.random(n) < p).astype(int)
    parts = [lm.Learner(2, 2, 1) for _ in range(2)]
    for learner, at in zip(parts, np.array_split(np.arange(n), 2), strict=True):
        learner.learn([x[at, 0], x[at, 1]], gate[at], np.zeros(len(at), int), bit[at], np.ones(len(at)), block=4096)
    mixer = parts[0].result(sum(learner.sums() for learner in parts))
    assert np.abs(mixer.weights - true).max() < 0.08
    # The logistic model is right here, so the refinement has little to refine.
    assert np.abs(mixer.table[0] - 1 / (1 + np.exp(-(np.arange(lm.STEPS) - 16) / 2)))[8:25].max() < 0.12


def test_own_bits_are_taken_out():
    for zero in range(6):
        for one in range(6):
            if zero + one:
                at = lm.pack(np.array([zero]), np.array([one]))[0]
                if zero == one:
                    continue  # equal counts look alike
                for bit in (0, 1):
                    left = (max(zero - 1, 0), one) if bit == 0 else (zero, max(one - 1, 0))
                    assert abs(lm.unpack(lm.WITHOUT_OWN[bit, at])[0] - math.log((left[1] + 0.4) / (left[0] + 0.4))) < 0.01


def test_letters_cover_all_rare_words(spark):
    """The spelling code's byte counts come from every word without a code, not from a sample of them."""
    words = [f"x{i:05d}" for i in range(9000)]
    got = {r["byte"]: r["n"] for r in lm.count_letters(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = np.bincount(np.frombuffer(" ".join([*words, ""]).encode(), np.uint8), minlength=256)
    assert [got[i] for i in range(256)] == want.tolist()


def test_rare_words_are_listed_with_their_counts(spark):
    """Words of both folds are spelled, and words too long for a code count by the join."""
    long = "y" * (lm.HEAD_BYTES + 1)
    rows = [(i, f"same words here {long} n{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs)
    rare = {r["word"]: r["c"] for r in model.rare.collect()}
    held = {r["doc_id"] for r in docs.where(lm.held_out(docs.doc_id)).collect()}
    assert rare[long] == 60 - len(held) and held
    assert all(rare[f"n{i}"] == (i not in held) for i in range(60))
    assert long not in model.word.words.to_pylist() and "same" in model.word.words.to_pylist()
    got = lm.score(docs, model).collect()
    assert {r["n_known"] for r in got if r["held_out"]} == {5} and {r["n_known"] for r in got if not r["held_out"]} == {6}


def test_grams_tell_every_byte_and_what_is_before():
    words = pa.array(["abcdef", "xbcdef", "abc", "é"])
    gram, at, owner = lm.SpellingModel.grams(words)
    want = []
    for i, w in enumerate(words.to_pylist()):
        raw = [256] * lm.ORDERS + [*w.encode(), 32]
        want += [(i, sum(raw[j - k] * 257**k for k in range(lm.ORDERS + 1))) for j in range(lm.ORDERS, len(raw))]
    assert list(zip(owner.tolist(), gram[at].tolist(), strict=True)) == want
