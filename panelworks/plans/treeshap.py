"""Exact Shapley values of boosted trees, their drivers, and a store that computes each value once.

A tree's value at a row, when only the features of a set are known, is the sum over its leaves
of the leaf's value times, for every feature on its path, whether the row satisfies the path's
conditions on it (known) or the share of training weight that does (unknown). The Shapley
value of such a product has a closed form: the integral over t in [0, 1] of the product of
(share (1 - t) + met t) over the other features of the path. The integrand is a polynomial of
degree below the path's length, so Gauss-Legendre nodes give it exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows whose paths are worked at once.
CHUNK = 1024


@dataclass(frozen=True)
class Forest:
    """All leaves of an ensemble: a row of arrays for each, padded to the longest path.

    value: the leaf's prediction times its tree's weight. feature: index of each feature on the
    path (-1: padding). low, high: the path's conditions low < x <= high; nan_ok: whether a
    missing value satisfies them, as it goes right everywhere. share: training weight of the
    path that satisfies them. classifier: the sum is a margin, half the log odds of class 1.
    """

    features: tuple[str, ...]
    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    nan_ok: np.ndarray
    share: np.ndarray
    classifier: bool

    @property
    def base(self) -> float:
        """The prediction when nothing is known: leaf values by their training weight."""
        return float((self.value * self.share.prod(axis=1)).sum())

    @property
    def digest(self) -> str:
        """What the model's values depend on, as a hex digest."""
        h = hashlib.sha256("\n".join(self.features).encode() + bytes([self.classifier]))
        for a in (self.value, self.feature, self.low, self.high, self.nan_ok, self.share):
            h.update(np.ascontiguousarray(a).tobytes())
        return h.hexdigest()[:24]

    def met(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves, path): whether each row satisfies each path's conditions; padding is met."""
        v = np.maximum(x, -np.finfo(float).max)[:, np.maximum(self.feature, 0)]  # the lowest infinity goes left too
        return ((v > self.low) & (v <= self.high)) | (np.isnan(v) & self.nan_ok) | (self.feature < 0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The ensemble's sum for every row."""
        parts = [self.met(x[i : i + CHUNK]).all(axis=2) @ self.value for i in range(0, len(x), CHUNK)]
        return np.concatenate(parts) if parts else np.empty(0)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): exact values; with :attr:`base` they add up to :meth:`predict`."""
        out = np.zeros((len(x), len(self.features)))
        nodes, weights = np.polynomial.legendre.leggauss(max(1, -(-self.feature.shape[1] // 2)))
        nodes, weights = (nodes + 1) / 2, weights / 2
        slot = np.zeros((self.feature.size, len(self.features)))
        real = self.feature.ravel() >= 0
        slot[np.flatnonzero(real), self.feature.ravel()[real]] = 1
        for i in range(0, len(x), CHUNK):
            met = self.met(x[i : i + CHUNK]).astype(float)
            gain = np.zeros_like(met)
            for t, w in zip(nodes, weights):
                factor = self.share * (1 - t) + met * t
                gain += w * factor.prod(axis=2, keepdims=True) / factor
            gain *= (met - self.share) * self.value[:, None]
            out[i : i + CHUNK] = gain.reshape(len(met), -1) @ slot
        return out


def flatten(model: PipelineModel) -> Forest:
    """The trees of a fitted :mod:`panelworks.plans.ml` model (assembler and boosted trees) as arrays."""
    ensemble = model.stages[-1]
    leaves: list[tuple[float, dict[int, list]]] = []

    def walk(node, weight: float, path: dict[int, list]) -> None:
        if not hasattr(node, "split") or node.getClass().getSimpleName() == "LeafNode":
            leaves.append((weight * node.prediction(), path))
            return
        split, j = node.split(), node.split().featureIndex()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("only splits of numbers are supported")
        total = node.impurityStats().count()
        low, high, nan_ok, share = path.get(j, [-np.inf, np.inf, True, 1.0])
        cut = split.threshold()
        for child, new in ((node.leftChild(), [low, min(high, cut), False]), (node.rightChild(), [max(low, cut), high, nan_ok])):
            walk(child, weight, path | {j: [*new, share * child.impurityStats().count() / total]})

    for tree, weight in zip(ensemble.trees, ensemble.treeWeights):
        walk(tree._java_obj.rootNode(), float(weight), {})
    width = max([1, *(len(p) for _, p in leaves)])
    shape = (len(leaves), width)
    feature, low, high = np.full(shape, -1, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf)
    nan_ok, share = np.ones(shape, np.bool_), np.ones(shape)
    for i, (_, path) in enumerate(leaves):
        for k, (j, (a, b, ok, s)) in enumerate(sorted(path.items())):
            feature[i, k], low[i, k], high[i, k], nan_ok[i, k], share[i, k] = j, a, b, ok, s
    names = tuple(model.stages[0].getInputCols())
    return Forest(names, np.array([v for v, _ in leaves]), feature, low, high, nan_ok, share, "Classif" in type(ensemble).__name__)


def tree_shapley(forest: Forest, rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, feature, shap) of every row: exact values of the ensemble's sum, in Arrow batches.

    The arrays are broadcast once. Nulls are missing values, which go right at every split;
    null and repeated keys stay; no rows give no values.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    kind = rows.select(key).schema[0].dataType.simpleString()
    names = list(forest.features)

    def run(batches):
        model = shared.value
        for b in batches:
            values = model.shapley(b[names].to_numpy(float))
            yield pd.DataFrame({"key_": b["key_"].repeat(len(names)).reset_index(drop=True), "feature": names * len(b), "shap": values.ravel()})

    columns = [F.col(c).cast("double").alias(c) for c in names]
    return rows.select(F.col(key).alias("key_"), *columns).mapInPandas(run, f"key_ {kind}, feature string, shap double").withColumnRenamed("key_", key)


def row_drivers(shap: DataFrame, k: int = 3, key: str = "id") -> DataFrame:
    """(key, raises, lowers): for every row the k features that raise and that lower the prediction most, strongest first."""
    pick = lambda sign: F.slice(F.array_sort(F.collect_list(F.when(F.col("shap") * sign > 0, F.struct((-F.abs("shap")).alias("m"), "feature")))), 1, k)
    out = shap.groupBy(key).agg(pick(1).alias("u"), pick(-1).alias("d"))
    return out.select(key, F.transform("u", lambda x: x["feature"]).alias("raises"), F.transform("d", lambda x: x["feature"]).alias("lowers"))


def cluster_drivers(shap: DataFrame, clusters: DataFrame, k: int = 3, key: str = "id") -> DataFrame:
    """(cluster, feature, n, mean_shap, mean_abs, rank, direction): the k features of each cluster with the largest mean |value|.

    clusters: (key, cluster). direction: ``+`` or ``-`` by the mean's sign. Sums combine before
    the shuffle; only a row for each cluster and feature is ranked.
    """
    g = shap.join(clusters.select(key, "cluster"), key).groupBy("cluster", "feature").agg(F.count("*").alias("n"), F.avg("shap").alias("mean_shap"), F.avg(F.abs("shap")).alias("mean_abs"))
    ranked = g.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("mean_abs"), "feature")))
    return ranked.where(F.col("rank") <= k).withColumn("direction", F.when(F.col("mean_shap") >= 0, "+").otherwise("-"))


class ShapleyStore:
    """Shapley values on disk, keyed by the model's digest, the row's id and a hash of its features.

    Values of rows that are there are read; only missing rows are computed. A batch is written
    to a hidden folder and then renamed, so it is there wholly or not at all, and values that
    two writers have both computed are read once.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _read(self, like: DataFrame, folder: str, schema: str) -> DataFrame:
        spark = like.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def values(self, forest: Forest, rows: DataFrame, key: str = "id") -> tuple[DataFrame, int]:
        """((key, feature, shap) of the rows, number of rows computed now). Keys are taken as unique and not null."""
        spark = rows.sparkSession
        kind = rows.select(key).schema[0].dataType.simpleString()
        folder = f"{self.path}/model={forest.digest}"
        schema = f"`{key}` {kind}, hash long, feature string, shap double"
        marked = rows.select(key, *forest.features, F.xxhash64(*[F.col(c).cast("double") for c in forest.features]).alias("hash"))
        held = self._read(rows, folder, schema)
        missing = marked.join(held.select(key, "hash").distinct(), [key, "hash"], "left_anti")
        computed = missing.count()
        if computed:
            fresh = tree_shapley(forest, missing, key).join(missing.select(key, "hash"), key).select(key, "hash", "feature", "shap")
            name = uuid.uuid4().hex
            staging, final = f"{self.path}/.staging-{name}", f"{folder}/batch-{name}"
            fresh.write.parquet(staging)
            path = spark._jvm.org.apache.hadoop.fs.Path
            system = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
            system.mkdirs(path(folder))
            if not system.rename(path(staging), path(final)):
                raise OSError(f"cannot move values to {final}")
            held = self._read(rows, folder, schema)
        once = held.groupBy(key, "hash", "feature").agg(F.first("shap").alias("shap"))
        return once.join(marked.select(key, "hash"), [key, "hash"]).select(key, "feature", "shap"), computed


def top_by_mean(shap: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, mean_abs, mean_shap) over all rows, largest mean |value| first."""
    rows = shap if features is None else shap.where(F.col("feature").isin(*features))
    return rows.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs"), F.avg("shap").alias("mean_shap")).orderBy(F.desc("mean_abs"), "feature")
