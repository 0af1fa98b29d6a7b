"""Boosted trees for quantiles: histograms of pinball-loss signs, leaf values from leaf quantiles.

Every round adds one tree for each quantile. A level of all these trees is one aggregation:
each partition counts, by node, feature and bin, its rows and those above their prediction;
the counts are added up, and the driver, which holds nothing but these few numbers, picks the
splits. A leaf's value is the exact quantile of the residuals that it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators.scoring import column_percentiles, grouped_percentiles, percentiles
from panelworks.session import materialise

#: Rounds after which predictions are written beside the rows, so that later rounds add only newer trees.
REFRESH = 8


@dataclass
class Tree:
    """A complete binary tree: the feature and bin of each inner node (feature -1: all go left), and leaf values.

    A row goes right if its bin is above the node's.
    """

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node, counted within its level, after so many levels."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[at]
            right = (f >= 0) & (bins[np.arange(len(bins)), np.maximum(f, 0)] > self.bin[at])
            at = 2 * at + 1 + right
        return at - ((1 << levels) - 1)


@dataclass
class QuantileTrees:
    """Fitted trees: ``trees[i]`` are those of ``alphas[i]``, to be added to ``base[i]``; ``losses`` has each round's validation loss."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    alphas: tuple[float, ...]
    depth: int
    base: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value: how many edges lie below it; missing values are above all."""
        out = np.empty(x.shape, np.int16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), len(e), np.searchsorted(e, x[:, j], "left"))
        return out

    def added(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """(rows, alphas): the sum of the trees from round ``start`` on."""
        out = np.zeros((len(bins), len(self.alphas)))
        for i, trees in enumerate(self.trees):
            for t in trees[start:]:
                out[:, i] += t.value[t.node(bins, self.depth)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, alphas) in rising order of alpha; crossing quantiles of a row are put in order."""
        return np.sort(self.base + self.added(self.bins(x)), axis=1)


def best_split(above: np.ndarray, count: np.ndarray, alpha: float, least: int) -> tuple[int, int]:
    """(feature, bin) that lowers the squared error of the loss's slopes most, from (feature, bin) counts; (-1, 0) if none does.

    Both sides keep ``least`` rows; ties go to the first feature and bin.
    """
    slope = above - (1 - alpha) * count
    n, g = count[0].sum(), slope[0].sum()
    left_n, left_g = count.cumsum(axis=1)[:, :-1], slope.cumsum(axis=1)[:, :-1]
    ok = (left_n >= least) & (n - left_n >= least)
    gain = np.where(ok, left_g**2 / np.maximum(left_n, 1) + (g - left_g) ** 2 / np.maximum(n - left_n, 1) - g * g / max(n, 1), -1.0)
    if not gain.size or gain.max() <= 1e-9:
        return -1, 0
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return int(f), int(b)


def _rows(batch: pa.RecordBatch, model: QuantileTrees, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, y, predictions) of a batch of the written table."""
    n = len(model.features)
    bins = batch.column(0).flatten().to_numpy().reshape(-1, n)
    held = batch.column(2).flatten().to_numpy().reshape(-1, len(model.alphas))
    return bins, batch.column(1).to_numpy(), held + model.added(bins, start)


def _level(data: DataFrame, model: QuantileTrees, growing: list[Tree], level: int, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows above their prediction, rows) by (alpha, node, feature, bin) of the level that is being grown."""
    shape = (len(model.alphas), 1 << level, len(model.features), width)
    size = int(np.prod(shape))

    def run(batches):
        above, count = np.zeros(size), np.zeros(size)
        for batch in batches:
            bins, y, predicted = _rows(batch, model, start)
            for i, tree in enumerate(growing):
                node = tree.node(bins, level)
                slot = ((i * shape[1] + node[:, None]) * shape[2] + np.arange(shape[2])) * width + bins
                count += np.bincount(slot.ravel(), minlength=size)
                above += np.bincount(slot[y > predicted[:, i]].ravel(), minlength=size)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(above[at].astype(np.int64)), pa.array(count[at].astype(np.int64))], ["slot", "above", "n"])

    found = data.where("NOT valid").select("bins", "y", "f").mapInArrow(run, "slot long, above long, n long").groupBy("slot").agg(F.sum("above").alias("above"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, size))
    out[:, found["slot"].to_numpy()] = [found["above"].to_numpy(), found["n"].to_numpy()]
    return out[0].reshape(shape), out[1].reshape(shape)


def _leaves(data: DataFrame, model: QuantileTrees, growing: list[Tree], start: int, rate: float) -> None:
    """Set the growing trees' leaf values: the residuals' quantile in each leaf, times the rate."""
    leaves = 1 << model.depth

    def run(batches):
        for batch in batches:
            bins, y, predicted = _rows(batch, model, start)
            for i, tree in enumerate(growing):
                yield pa.RecordBatch.from_arrays([pa.array(i * leaves + tree.node(bins, model.depth)), pa.array(y - predicted[:, i])], ["leaf", "residual"])

    residuals = data.where("NOT valid").select("bins", "y", "f").mapInArrow(run, "leaf long, residual double")
    for r in grouped_percentiles(residuals, "leaf", "residual", model.alphas).select("leaf", "p").collect():  # a row for each leaf
        i, leaf = divmod(r["leaf"], leaves)
        growing[i].value[leaf] = rate * r["p"][i]


def _loss(data: DataFrame, model: QuantileTrees, start: int) -> float:
    """Mean pinball loss over the validation rows and quantiles."""
    alphas = np.array(model.alphas)

    def run(batches):
        for batch in batches:
            _, y, predicted = _rows(batch, model, start)
            over = y[:, None] - predicted
            yield pa.RecordBatch.from_arrays([pa.array([float(np.maximum(alphas * over, (alphas - 1) * over).sum())]), pa.array([len(y) * len(alphas)])], ["loss", "n"])

    one = data.where("valid").select("bins", "y", "f").mapInArrow(run, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
    return one[0] / one[1] if one[1] else float("nan")


def fit_quantiles(train: DataFrame, features: Sequence[str], target: str, *, alphas: Sequence[float] = (0.1, 0.9), rounds: int = 20, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, validation: str | None = None, patience: int = 3) -> QuantileTrees:
    """Trees for several quantiles of a target.

    Rows without a target are left out; missing features go right. ``validation`` names a
    boolean column: its rows are not fitted, and fitting stops when their loss has not fallen
    for ``patience`` rounds, keeping the best round's trees. Without rows all predictions are 0.
    """
    features = tuple(features)
    cut = column_percentiles(train.where(F.col(target).isNotNull() & (F.lit(True) if validation is None else ~F.col(validation))), features, [k / bins for k in range(1, bins)]).first()
    edges = [np.unique(np.array(p, float)) if p else np.empty(0) for p in (cut[f"p_{f}"] for f in features)]
    base = percentiles(train.where(F.col(target).isNotNull() if validation is None else ~F.col(validation)), target, alphas).first()[0]
    model = QuantileTrees(features, edges, tuple(alphas), depth, np.array(base or [0.0] * len(alphas), float), [[] for _ in alphas])
    empty = len(alphas) * [0.0]

    def binned(batches):
        for b in batches:
            if len(b):
                got = model.bins(b[list(features)].to_numpy(float))
                yield pd.DataFrame({"bins": list(got), "y": b["y_"], "valid": b["valid_"], "f": [model.base + empty] * len(b)})

    rows = train.where(F.col(target).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("y_"), (F.col(validation) if validation else F.lit(False)).alias("valid_"))
    data = materialise(rows.mapInPandas(binned, "bins array<smallint>, y double, valid boolean, f array<double>"), "boosting")
    start, width, best = 0, max(len(e) for e in edges) + 1, (float("inf"), 0)
    for made in range(rounds):
        growing = [Tree(np.full((1 << depth) - 1, -1, np.int64), np.zeros((1 << depth) - 1, np.int64), np.zeros(1 << depth)) for _ in alphas]
        for level in range(depth):
            above, count = _level(data, model, growing, level, start, width)
            for i, tree in enumerate(growing):
                for node in range(1 << level):
                    at = (1 << level) - 1 + node
                    tree.feature[at], tree.bin[at] = best_split(above[i, node], count[i, node], alphas[i], least)
        _leaves(data, model, growing, start, rate)
        for trees, tree in zip(model.trees, growing):
            trees.append(tree)
        if validation is not None:
            model.losses.append(_loss(data, model, start))
            if model.losses[-1] < best[0] - 1e-12:
                best = (model.losses[-1], made + 1)
            elif made + 1 - best[1] >= patience:
                break
        if made + 1 - start >= REFRESH and made + 1 < rounds:
            data, start = _refreshed(data, model, start), made + 1
    if validation is not None and best[1]:
        model.trees = [t[: best[1]] for t in model.trees]
    return model


def _refreshed(data: DataFrame, model: QuantileTrees, start: int) -> DataFrame:
    """The table with the newer trees added to its predictions."""

    def run(batches):
        for batch in batches:
            _, _, predicted = _rows(batch, model, start)
            bound = pa.array(np.arange(len(predicted) + 1) * predicted.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.ListArray.from_arrays(bound, pa.array(predicted.ravel()))], ["bins", "y", "valid", "f"])

    return materialise(data.select("bins", "y", "f", "valid").mapInArrow(run, "bins array<smallint>, y double, valid boolean, f array<double>"), "boosting")


def predict_quantiles(model: QuantileTrees, df: DataFrame, to: Sequence[str]) -> DataFrame:
    """``df`` with a column for each quantile, in rising order."""

    @F.pandas_udf("array<double>")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(model.predict(x.to_numpy(float))))

    values = run(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))
    out = df.withColumn("q_", values)
    return out.withColumns({name: F.col("q_")[i] for i, name in enumerate(to)}).drop("q_")
