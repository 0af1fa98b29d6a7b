"""URL filters: host rules, and gradient-boosted trees on lexical features for other URLs.

The trees learn to tell hosts that hold a listed word from ordinary pages. Rules are no
labels: they say nothing about how a bad URL looks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import ship_package, utf8_buffer

#: Labelled URLs used for training, at most, of either label; taken in the order of their MD5.
SAMPLE_BLOCK, SAMPLE_ALLOW = 5_000, 15_000

#: Words in a host that label a URL as one to block.
SEED_WORDS = ("casino", "pills", "spam", "viagra", "porn", "xxx", "betting", "lottery", "adult")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and for paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct of name and verdict, null if none fits."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


#: Columns that features are made of, in this order.
PARTS = ("url_", "host_", "path_", "query_", "suffix_")


def parts(url: Column) -> list[Column]:
    """The columns PARTS of a URL (null: empty): itself, host, path, query, and a hash of the host's last label."""
    host, path = host_and_path(url)
    whole = F.coalesce(url, F.lit(""))
    query = F.when(F.instr(whole, "://") > 0, F.regexp_extract(F.substring(whole, F.instr(whole, "://") + 3, F.length(whole)), r"^[^?#]*\?([^#]*)", 1)).otherwise("")
    columns = (whole, host, path, query, F.xxhash64(F.substring_index(host, ".", -1)))
    return [c.alias(n) for c, n in zip(columns, PARTS, strict=True)]


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "parameters", "hyphens", "suffix_rate", "suffix_share")


def _entropy(text: pa.Array) -> np.ndarray:
    """Bits a byte of every string's own byte counts."""
    out = np.zeros(len(text))
    for low in range(0, len(text), 4096):
        data, offsets = utf8_buffer(text.slice(low, 4096))
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(size)), size)
        n = np.bincount(row * 256 + data, minlength=256 * len(size)).reshape(-1, 256)
        share = n / np.maximum(size, 1)[:, None]
        out[low : low + len(size)] = -(share * np.log2(np.where(n, share, 1))).sum(1)
    return out


def lexical(columns: Sequence[pa.Array]) -> np.ndarray:
    """All features of URLs given as their PARTS but the two of the suffix."""
    url, host, path, query = columns[:4]
    number = lambda x: pc.cast(x, pa.float64()).to_numpy(zero_copy_only=False)
    length = [number(pc.utf8_length(x)) for x in (url, host, path)]
    digits = [number(pc.count_substring_regex(x, "[0-9]")) / np.maximum(n, 1) for x, n in zip((url, host), length)]
    depth, labels = number(pc.count_substring_regex(path, "[^/]+")), number(pc.count_substring(host, ".")) + (length[1] > 0)
    return np.stack([*length, depth, labels, *digits, _entropy(url), _entropy(host), number(pc.count_substring_regex(query, "[^&]+")), number(pc.count_substring(host, "-"))], 1)


class Trees:
    """Boosted regression trees on the logistic loss, grown on quantile-binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, leaf: float = 2.0, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.l2 = trees, depth, rate, bins, leaf, l2
        self.bias, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """x: rows by features, y: 0 or 1. With no rows or one label only, the score is the label's rate."""
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = math.log(p / (1 - p))
        if len(y) == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        total = np.full(len(y), self.bias)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(code, cuts, p - y, p * (1 - p))
            self.nodes.append(tree)
            total += self._walk(tree, x)
        return self

    def _grow(self, code: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple]:
        nodes: list[tuple] = []

        def grow(at: np.ndarray, depth: int) -> int:
            me = len(nodes)
            gs, hs = g[at].sum(), h[at].sum()
            nodes.append((-1, 0.0, -1, -1, -self.rate * gs / (hs + self.l2)))
            best = (1e-6, -1, -1)
            for f in range(code.shape[1]) if depth else ():
                n = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(code[at, f], g[at], n))[:-1]
                hl = np.cumsum(np.bincount(code[at, f], h[at], n))[:-1]
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(hl < self.leaf) | (hs - hl < self.leaf)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                f, b = best[1:]
                left = code[at, f] <= b
                nodes[me] = (f, float(cuts[f][b]), grow(at[left], depth - 1), grow(at[~left], depth - 1), 0.0)
            return me

        grow(np.arange(len(g)), self.depth)
        return nodes

    @staticmethod
    def _walk(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))

        def walk(node: int, at: np.ndarray) -> None:
            f, cut, left, right, value = tree[node]
            if f < 0:
                out[at] = value
                return
            low = x[at, f] <= cut
            walk(left, at[low])
            walk(right, at[~low])

        walk(0, np.arange(len(x)))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.bias)
        for tree in self.nodes:
            total += self._walk(tree, x)
        return 1 / (1 + np.exp(-total))


@dataclass
class Model:
    """Trees, and for each suffix of the sample (by hash, in order) the rate of label 1 and the share of URLs."""

    trees: Trees
    suffixes: np.ndarray
    rates: np.ndarray
    shares: np.ndarray
    prior: float

    def block_probability(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """Probability of label 1 of URLs given as their PARTS."""
        suffix = columns[4].to_numpy(zero_copy_only=False)
        rate, share = np.full(len(suffix), self.prior), np.zeros(len(suffix))
        if len(self.suffixes):
            at = np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)
            found = self.suffixes[at] == suffix
            rate[found], share[found] = self.rates[at[found]], self.shares[at[found]]
        return self.trees.predict(np.column_stack([lexical(columns), rate, share]))


#: Weight of the overall rate in a suffix's own.
SMOOTHING = 10


def fit(x: np.ndarray, suffix: np.ndarray, y: np.ndarray) -> Model:
    """Fit on lexical features, suffix hashes and labels (1 for block).

    Suffix rates are smoothed towards the overall rate; a training row's own label is left
    out of the rate that it is given.
    """
    n = len(y)
    overall = float(y.mean()) if n else 0.0
    known, at = np.unique(suffix, return_inverse=True)
    seen, bad = np.bincount(at, minlength=len(known)), np.bincount(at, weights=y, minlength=len(known))
    own = (bad[at] - y + SMOOTHING * overall) / (seen[at] - 1 + SMOOTHING) if n else np.empty(0)
    trees = Trees().fit(np.column_stack([x.reshape(n, -1), own, seen[at] / max(1, n)]) if n else np.empty((0, len(FEATURES))), y)
    return Model(trees, known, (bad + SMOOTHING * overall) / (seen + SMOOTHING), seen / max(1, n), overall)


def train(labelled: DataFrame) -> Model:
    """Fit on at most SAMPLE_BLOCK and SAMPLE_ALLOW different URLs of ``labelled`` (url, label 1 for block).

    A URL with both labels counts as blocked; null URLs and labels are left out. Only the
    features of the sample come to the driver, not its URLs.
    """
    ship_package(labelled.sparkSession)
    once = labelled.where("url IS NOT NULL AND label IN (0, 1)").groupBy("url").agg(F.max("label").cast("int").alias("label"))
    part = lambda y, n: once.where(F.col("label") == y).orderBy(F.md5("url"), "url").limit(n)
    sample = part(1, SAMPLE_BLOCK).union(part(0, SAMPLE_ALLOW)).select("label", *parts(F.col("url")))

    def run(batches):
        for b in batches:
            x = lexical(b.columns[1:])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), lists], ["label", "suffix", "x"])

    rows = sorted((list(r["x"]), r["suffix"], r["label"]) for r in sample.mapInArrow(run, "label int, suffix long, x array<double>").collect())
    return fit(np.array([r[0] for r in rows], np.float64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64))


def labelled_by(pages: DataFrame, *, url: str = "url", seed_words: Sequence[str] = SEED_WORDS) -> DataFrame:
    """(url, label): 1 if a seed word is in the host, else 0; URLs without a host are left out."""
    host, _ = host_and_path(F.col(url))
    seed = F.lit(False)
    for w in seed_words:
        seed = seed | F.contains(host, F.lit(w))
    return pages.where(host != "").select(F.col(url).alias("url"), seed.cast("int").alias("label"))


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, block_probability) of every page.

    The rule's verdict holds where one fits; else block from a probability of 0.5 on. Null
    URLs are judged as empty ones. Repeated rows and null keys stay, other columns are
    ignored, an empty table gives an empty result.
    """
    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key_"), *parts(F.col(url)), rule_for(host, path, rules).alias("fit_"))
    rows = rows.select("key_", *PARTS, F.col("fit_.name").alias("rule"), F.col("fit_.verdict").alias("said_"))
    kind = rows.schema["key_"].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = model.block_probability(b.columns[1:6])
            verdict = pc.coalesce(b.column(7), pc.if_else(pa.array(p >= 0.5), "block", "allow"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(6), verdict, pa.array(p)], ["key_", "host", "path", "rule", "verdict", "block_probability"])

    return rows.mapInArrow(run, f"key_ {kind}, host string, path string, rule string, verdict string, block_probability double").withColumnRenamed("key_", key)
