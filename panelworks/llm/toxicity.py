"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training is online over a bounded sample of labelled texts, with a learning rate for every
coordinate and L1 regularisation; the weights that differ from zero are few and are shipped
with the scoring task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import Words, mix, multipliers, ship_package, slices

#: Bits of a feature's index.
BITS = 20
#: Labelled texts used for training, at most, of either label; taken in the order of their keys' MD5.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1500, 3000

#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6)
#: A feature is used from so many texts of the sample on.
MIN_TEXTS = 3

_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_PUNCTUATION + _UPPER, b" " * len(_PUNCTUATION) + _UPPER.lower())


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, feature) of every word, word pair and pair with one word between.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A longer
    word also counts with its first bytes, for forms of one stem.
    """
    words = Words(text, lower=True, table=_TABLE)
    h, doc, odd = words.hashes(), words.doc, multipliers(8)
    found, owner = [mix(h * odd[2])], [doc]
    for gap, (a, b) in ((1, (3, 4)), (2, (5, 6))):
        same = np.flatnonzero(doc[:-gap] == doc[gap:]) if len(doc) > gap else np.empty(0, np.int64)
        found.append(mix(h[same] * odd[a] + h[same + gap] * odd[b]))
        owner.append(doc[same])
    for k in STEMS:
        longer = np.flatnonzero(words.lengths > k)
        found.append(mix(words.hashes(k)[longer] * odd[7] + np.uint64(k)))
        owner.append(doc[longer])
    return np.concatenate(owner), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_features(text: pa.Array, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`features`, each feature of a text once, ordered; ``allowed`` masks the features."""
    owner, feature = features(text)
    if allowed is not None:
        keep = allowed[feature]
        owner, feature = owner[keep], feature[keep]
    key = np.unique((owner << BITS) | feature)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Bias, and the indices and values of the weights that are not zero."""

    bias: float
    index: np.ndarray
    value: np.ndarray

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.index] = self.value
        return table


def fit_ftrl(rows: list[tuple[int, np.ndarray]], *, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 10) -> Model:
    """FTRL-proximal on (label, features present) in the order given, ``epochs`` times.

    With no rows the model says 0.5 for everything; with one label only, it stays near that label's rate.
    """
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for label, present in rows:
            at = np.append(present, size - 1)
            zi, ni = z[at], n[at]
            shrunk = np.maximum(np.abs(zi) - l1, 0)
            shrunk[-1] = abs(zi[-1])  # the bias is not shrunk
            w = -np.sign(zi) * shrunk / ((beta + np.sqrt(ni)) / alpha + l2)
            g = 1 / (1 + np.exp(-min(max(w.sum(), -35), 35))) - label
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    shrunk = np.maximum(np.abs(z) - l1, 0)
    shrunk[-1] = abs(z[-1])
    w = -np.sign(z) * shrunk / ((beta + np.sqrt(n)) / alpha + l2)
    index = np.flatnonzero(w[:-1])
    return Model(float(w[-1]), index, w[index])


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 3; null for a null key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most SAMPLE_POSITIVE + SAMPLE_NEGATIVE labelled texts of the training folds.

    Rows whose :func:`fold` is 1 are held out. A key labelled twice counts as toxic if one of
    its labels says so; null labels and keys are left out; of documents that share a key one
    is used.
    """
    ship_package(docs.sparkSession)
    usable = labels.where(fold(F.col(key)) != 1).groupBy(F.col(key).alias("key_")).agg(F.max(label).alias("label_")).where("label_ IN (0, 1)")
    order = [F.md5(F.col("key_").cast("string")), "key_"]
    chosen = usable.where("label_ = 1").orderBy(*order).limit(SAMPLE_POSITIVE).union(usable.where("label_ = 0").orderBy(*order).limit(SAMPLE_NEGATIVE))
    rows = docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_"))
    # Not more than SAMPLE_POSITIVE + SAMPLE_NEGATIVE keys and labels are broadcast.
    rows = rows.join(F.broadcast(chosen), "key_").select(F.md5(F.col("key_").cast("string")).alias("key_"), "label_", "text_")

    def run(batches):
        for piece, texts in slices(batches, "text_"):
            owner, feature = distinct_features(texts)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            data = feature.astype("<i4")
            found = [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1).cast(pa.int32()), pa.array(found, pa.binary())], ["key_", "label_", "found"])

    sample = rows.mapInArrow(run, "key_ string, label_ int, found binary").groupBy("key_").agg(F.min_by(F.struct("label_", "found"), "found").alias("r")).select("key_", "r.*")
    texts = sorted((r["key_"], r["label_"], bytes(r["found"])) for r in sample.collect())
    rows = [(y, np.frombuffer(x, "<i4")) for _, y, x in texts]
    in_texts = np.zeros(1 << BITS, np.int32)
    for _, present in rows:
        in_texts[present] += 1
    often = in_texts >= MIN_TEXTS
    return fit_ftrl([(y, present[often[present]]) for y, present in rows])


def score_array(text: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    """Scores in (0, 1) of a null-free string array; texts without known features get the bias's."""
    owner, feature = distinct_features(text, table != 0)
    total = np.bincount(owner, weights=table[feature], minlength=len(text)) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, *, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``to``: the score of each whole text (null text: empty).

    Rows, repeated ones too, and all other columns stay as they are; a column named ``to``
    is replaced.
    """
    ship_package(docs.sparkSession)
    plain = docs.drop(to) if to in docs.columns else docs
    names = plain.columns
    inner = plain.toDF(*[f"c{i}" for i in range(len(names))])
    column = f"c{names.index(text)}"

    def run(batches):
        table = model.table()
        for piece, texts in slices(batches, column):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score_array(texts, model, table))], [*piece.schema.names, "score_"])

    return inner.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*inner.dtypes, ("score_", "double")])).toDF(*names, to)
