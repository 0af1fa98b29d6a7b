"""Models fitted by gradients that are added up over the table: gates, hierarchical paths, embeddings, cluster refinement.

Parameters are a few numbers on the driver. A step sends them out with the task, every
partition adds up its rows' gradients in numpy, and one aggregation by position adds these.
Rows are written once as arrays, so a step reads nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.session import materialise


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column whose lists all have ``width`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def added(data: DataFrame, local: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``local``'s vectors over all batches of a table; zeros for a table without rows."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += local(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

    found = data.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


class Adam:
    """Adam steps of a vector."""

    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _prepared(df: DataFrame, features: Sequence[str], target: str, key: str, batches: int, seed: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((part, x, y) with all columns at mean 0 and deviation 1, means, deviations); the target is last in these.

    Missing features count as their mean; rows without a target are left out.
    """
    names = [*features, target]
    rows = df.where(F.col(target).isNotNull())
    one = rows.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]).first()
    mean = np.array([one[f"m{i}"] or 0.0 for i in range(len(names))])
    scale = np.array([one[f"s{i}"] or 1.0 for i in range(len(names))])
    z = [F.coalesce((F.col(c).cast("double") - float(m)) / float(s), F.lit(0.0)) for c, m, s in zip(names, mean, scale)]
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(batches)).cast("int")
    return materialise(rows.select(part.alias("part"), F.array(*z[:-1]).alias("x"), z[-1].alias("y")), "descent"), mean, scale


@dataclass
class Gates:
    """Fitted gates: ``open`` is each feature's probability of an open gate, ``gate`` its value without noise."""

    features: tuple[str, ...]
    weight: np.ndarray
    mu: np.ndarray
    sigma: float
    losses: list[float] = field(default_factory=list)

    @property
    def open(self) -> np.ndarray:
        return 1 / (1 + np.exp(-1.702 * (0.5 + self.mu) / self.sigma))

    @property
    def gate(self) -> np.ndarray:
        return np.clip(0.5 + self.mu, 0, 1)


def gate_gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, gates: np.ndarray) -> np.ndarray:
    """Sums over rows for each draw of the gates (draws, features): of residual times x, then squared residuals, then rows."""
    residual = x @ (gates * weight).T - y[:, None]
    return np.concatenate([(residual.T @ x).ravel(), (residual**2).sum(axis=0), [len(y)]])


def fit_gates(df: DataFrame, features: Sequence[str], target: str, *, key: str = "id", steps: int = 80, penalty: float = 0.08, sigma: float = 0.5, rate: float = 0.1, draws: int = 4, batches: int = 2, seed: int = 42) -> Gates:
    """Linear regression through stochastic gates with a penalty on the expected number of open ones.

    A step takes one hashed part of the rows and ``draws`` noise vectors: a gate is 0.5 + mu + noise
    within [0, 1], so its gradient is that of the weight wherever it is not cut off. Features
    and target are brought to mean 0 and deviation 1.
    """
    data, *_ = _prepared(df, features, target, key, batches, seed)
    n = len(features)
    model = Gates(tuple(features), np.zeros(n), np.zeros(n), sigma)
    adam = Adam(2 * n, rate)
    for t in range(steps):
        noise = sigma * np.random.default_rng([seed, t]).standard_normal((draws, n))
        raw = 0.5 + model.mu + noise
        gates, weight = np.clip(raw, 0, 1), model.weight
        got = added(data.where(F.col("part") == t % batches).select("x", "y"), lambda b: gate_gradient(matrix(b.column(0), n), b.column(1).to_numpy(), weight, gates), draws * n + draws + 1)  # noqa: B023
        rows = max(got[-1], 1.0)
        slope = got[: draws * n].reshape(draws, n) / rows
        p = model.open
        g_weight = (slope * gates).mean(axis=0)
        g_mu = (slope * weight * ((raw > 0) & (raw < 1))).mean(axis=0) + penalty * p * (1 - p) * 1.702 / sigma
        move = adam.step(np.concatenate([g_weight, g_mu]))
        model.weight, model.mu = model.weight + move[:n], model.mu + move[n:]
        model.losses.append(float(got[draws * n : -1].mean() / rows))
    return model


def hier_prox(v: np.ndarray, u: np.ndarray, penalty: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(beta, theta) least in (beta - v)**2 / 2 + |theta - u|**2 / 2 + penalty |beta| with every |theta| <= bound |beta|.

    v: a number for each feature; u: (features, hidden). The largest ``m`` of a feature's |u| are cut
    to the bound; the one ``m`` for which that is consistent gives the solution.
    """
    size = np.sort(np.abs(u), axis=1)[:, ::-1]
    k = u.shape[1]
    head = np.concatenate([np.zeros((len(u), 1)), np.cumsum(size, axis=1)], axis=1)
    m = np.arange(k + 1)
    w = bound / (1 + m * bound**2) * np.maximum(np.abs(v)[:, None] + bound * head - penalty, 0)
    below = np.concatenate([size, np.zeros((len(u), 1))], axis=1)
    at = np.argmax(w >= below, axis=1)  # the first m that leaves no larger |u| uncut
    cut = w[np.arange(len(u)), at]
    return np.sign(v) * cut / bound, np.sign(u) * np.minimum(np.abs(u), cut[:, None])


def _path_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, theta: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Gradients of half the squared error for beta, theta and top, then the error's sum and the rows."""
    hidden = x @ theta
    active = np.maximum(hidden, 0)
    residual = x @ beta + active @ top - y
    back = residual[:, None] * top * (hidden > 0)
    return np.concatenate([x.T @ residual, (x.T @ back).ravel(), active.T @ residual, [residual @ residual / 2, len(y)]])


def hier_path(df: DataFrame, features: Sequence[str], target: str, penalties: Sequence[float], *, key: str = "id", hidden: int = 6, bound: float = 2.0, start: int = 40, steps: int = 10, rate: float = 0.2, seed: int = 42) -> DataFrame:
    """(penalty, feature, weight, kept, loss): a linear model with a hidden layer along rising penalties.

    A feature may use the hidden layer only within ``bound`` times its linear weight, so a weight of
    0 drops it altogether. The first fit has no penalty; every other one goes on from the one
    before it by proximal gradient steps, and what was dropped stays out.
    """
    data, *_ = _prepared(df, features, target, key, 1, seed)
    n, rng = len(features), np.random.default_rng(seed)
    beta, theta, top = rng.normal(0, 0.1, n), rng.normal(0, 0.3, (n, hidden)), rng.normal(0, 0.3, hidden)
    kept, out = np.ones(n, np.bool_), []
    sizes = np.cumsum([n, n * hidden, hidden])
    for penalty, count in [(0.0, start), *((float(p), steps) for p in sorted(penalties))]:
        loss = float("nan")
        for _ in range(count):
            got = added(data.select("x", "y"), lambda b: _path_sums(matrix(b.column(0), n), b.column(1).to_numpy(), beta, theta, top), int(sizes[-1]) + 2)  # noqa: B023
            rows = max(got[-1], 1.0)
            loss = got[-2] / rows
            g_beta, g_theta, g_top = np.split(got[:-2] / rows, sizes[:2])
            beta, theta = hier_prox(beta - rate * g_beta, theta - rate * g_theta.reshape(n, hidden), rate * penalty, bound)
            top = top - rate * g_top
            beta, theta = np.where(kept, beta, 0.0), np.where(kept[:, None], theta, 0.0)
        kept &= beta != 0
        if penalty or not penalties:
            out += [(penalty, f, float(w), bool(k), float(loss)) for f, w, k in zip(features, beta, kept)]
    return df.sparkSession.createDataFrame(out, "penalty double, feature string, weight double, kept boolean, loss double")


@dataclass
class EmbeddingNet:
    """Category embeddings and numbers through a hidden layer and a residual block to one output.

    ``shapes`` names the parts of the parameter vector ``params``; mean and scale bring numbers (and a
    regression's target, last) to mean 0 and deviation 1.
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    sizes: tuple[int, ...]
    dims: int
    hidden: int
    kind: str
    pos_weight: float
    params: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    losses: list[float] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    def shapes(self) -> list[tuple[int, ...]]:
        width = self.dims * len(self.sizes) + len(self.numeric)
        h = self.hidden
        return [*((s, self.dims) for s in self.sizes), (width, h), (h,), (h, h), (h,), (h,), (1,)]

    def parts(self, params: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes()])
        return [p.reshape(s) for p, s in zip(np.split(params, ends[:-1]), self.shapes())]

    def loss(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss, slope) of every row: Huber with width 1, or cross entropy with weighted positives."""
        if self.kind == "huber":
            r = z - y
            return np.where(np.abs(r) <= 1, r * r / 2, np.abs(r) - 0.5), np.clip(r, -1, 1)
        w = np.where(y > 0.5, self.pos_weight, 1.0)
        return w * (np.logaddexp(0, z) - y * z), w * (1 / (1 + np.exp(-z)) - y)

    def forward(self, params: np.ndarray, codes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        *tables, p, p0, q, q0, o, o0 = self.parts(params)
        e = np.concatenate([*(t[codes[:, i]] for i, t in enumerate(tables)), x], axis=1)
        a = np.maximum(e @ p + p0, 0)
        b = np.maximum(a @ q + q0, 0)
        return (a + b) @ o + o0[0], (e, a, b)

    def sums(self, params: np.ndarray, codes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of the summed loss, then that sum and the rows."""
        *tables, p, _, q, _, o, _ = self.parts(params)
        z, (e, a, b) = self.forward(params, codes, x)
        each, d = self.loss(z, y)
        d_sum = d[:, None] * o
        d_b = d_sum * (b > 0)
        d_a = (d_sum + d_b @ q.T) * (a > 0)
        d_e = d_a @ p.T
        grads = []
        for i, t in enumerate(tables):
            g = np.zeros_like(t)
            np.add.at(g, codes[:, i], d_e[:, i * self.dims : (i + 1) * self.dims])
            grads.append(g.ravel())
        grads += [(e.T @ d_a).ravel(), d_a.sum(axis=0), (a.T @ d_b).ravel(), d_b.sum(axis=0), (a + b).T @ d, [d.sum()]]
        return np.concatenate([*grads, [each.sum(), len(y)]])


def fit_embeddings(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, *, key: str = "id", kind: str = "huber", pos_weight: float = 9.0, dims: int = 3, hidden: int = 12, epochs: int = 60, batches: int = 1, rate: float = 0.03, patience: int = 5, share: float = 0.2, seed: int = 42) -> EmbeddingNet:
    """Data-parallel Adam steps on a regression (``huber``) or classification (``bce``, positives weighted).

    Categorical columns hold codes from 0; missing and negative ones are code 0. A hashed share of the
    rows is held out: when its loss has not fallen for ``patience`` epochs the rate is halved, after
    twice as many fitting stops, and the best epoch's parameters are kept.
    """
    one = df.agg(*[F.max(F.col(c)).alias(c) for c in categorical]).first() if categorical else {}
    sizes = tuple(max(int(one[c] or 0), 0) + 1 for c in categorical)
    names = [*numeric, target]
    stats = df.where(F.col(target).isNotNull()).agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(names))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(names))])
    if kind == "bce":
        mean[-1], scale[-1] = 0.0, 1.0
    net = EmbeddingNet(tuple(numeric), tuple(categorical), sizes, dims, hidden, kind, pos_weight, np.empty(0), mean, scale)
    rng = np.random.default_rng(seed)
    net.params = np.concatenate([(rng.normal(0, 1 / np.sqrt(s[0]) if len(s) > 1 and i >= len(sizes) else 0.3, s) if len(s) > 1 or i == len(net.shapes()) - 2 else np.zeros(s)).ravel() for i, s in enumerate(net.shapes())])
    data = materialise(df.where(F.col(target).isNotNull()).select(*_inputs(net), ((F.col(target).cast("double") - float(mean[-1])) / float(scale[-1])).alias("y"), F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)).alias("at")), "embeddings")
    held, cut = data.where(F.col("at") < int(share * 10_000)).select("codes", "x", "y"), int(share * 10_000)
    adam, size = Adam(len(net.params), rate), len(net.params) + 2
    best, kept, since, halved = float("inf"), net.params, 0, 0

    def total(rows: DataFrame, params: np.ndarray) -> np.ndarray:
        n, m = len(net.categorical), len(net.numeric)
        return added(rows, lambda b: net.sums(params, matrix(b.column(0), n).astype(np.int64), matrix(b.column(1), m), b.column(2).to_numpy()), size)

    for _ in range(epochs):
        for part in range(batches):
            got = total(data.where((F.col("at") >= cut) & (F.col("at") % batches == part)).select("codes", "x", "y"), net.params)
            net.params = net.params + adam.step(got[:-2] / max(got[-1], 1.0))
        got = total(held, net.params)
        net.losses.append(float(got[-2] / max(got[-1], 1.0)))
        net.rates.append(adam.rate)
        if net.losses[-1] < best - 1e-6:
            best, kept, since, halved = net.losses[-1], net.params, 0, 0
        else:
            since += 1
            if since >= patience:
                adam.rate, since, halved = adam.rate / 2, 0, halved + 1
            if halved >= 2:
                break
    net.params = kept
    return net


def _inputs(net: EmbeddingNet) -> list:
    codes = [F.least(F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(0)), F.lit(0)), F.lit(s - 1)) for c, s in zip(net.categorical, net.sizes)]
    x = [F.coalesce((F.col(c).cast("double") - float(m)) / float(s), F.lit(0.0)) for c, m, s in zip(net.numeric, net.mean, net.scale)]
    return [F.array(*codes).cast("array<int>").alias("codes"), F.array(*x).cast("array<double>").alias("x")]


def predict_embeddings(net: EmbeddingNet, df: DataFrame, to: str) -> DataFrame:
    """``to``: the predicted value, or the probability of class 1. Codes beyond those seen are the last one."""

    @F.pandas_udf("double")
    def run(codes: pd.Series, x: pd.Series) -> pd.Series:
        z, _ = net.forward(net.params, np.array(codes.tolist(), np.int64).reshape(len(codes), -1), np.array(x.tolist(), float).reshape(len(x), -1))
        return pd.Series(z * net.scale[-1] + net.mean[-1] if net.kind == "huber" else 1 / (1 + np.exp(-z)))

    return df.withColumn(to, run(*_inputs(net)))


def soft(z: np.ndarray, centres: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(q, kernel) of rows and centres: Student-t soft assignment, and 1 / (1 + distance**2 / alpha)."""
    kernel = 1 / (1 + ((z[:, None, :] - centres) ** 2).sum(axis=2) / alpha)
    q = kernel ** ((alpha + 1) / 2)
    return q / q.sum(axis=1, keepdims=True), kernel


def refine_clusters(points: DataFrame, k: int, *, vector: str = "vector", starts: int = 4, rounds: int = 5, steps: int = 4, least: float = 0.001, alpha: float = 1.0, seed: int = 42) -> tuple[np.ndarray, DataFrame, float]:
    """(centres, (round, step, kl) of every step, cost of the k-means start).

    The best of several k-means starts is refined: each round fixes the target distribution of its
    centres (assignments squared over the clusters' sums) and lowers its divergence from the
    assignments by gradient steps, of which the best of several lengths is taken; a step that
    does not lower it ends the round. Rounds end when fewer than ``least`` of the rows change
    their cluster.
    """
    data = materialise(points.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("z")), "refine")
    ready = data.select(array_to_vector("z").alias("features"))
    fits = [KMeans(k=k, seed=seed + i).fit(ready) for i in range(starts)]
    first = min(fits, key=lambda m: m.summary.trainingCost)
    centres = np.array([c for c in first.clusterCenters()])
    wide, history = centres.shape[1], []
    lengths = np.array([4.0, 1.0, 0.25, 0.0625])
    for r in range(rounds):
        base = centres.copy()
        sums = added(data, lambda b: soft(matrix(b.column(0), wide), base, alpha)[0].sum(axis=0), len(centres))  # noqa: B023
        rows = max(sums.sum(), 1.0)

        def target(z: np.ndarray) -> np.ndarray:
            p = soft(z, base, alpha)[0] ** 2 / np.maximum(sums, 1e-300)  # noqa: B023
            return p / p.sum(axis=1, keepdims=True)

        def slope(b: pa.RecordBatch) -> np.ndarray:
            z = matrix(b.column(0), wide)
            q, kernel = soft(z, centres, alpha)  # noqa: B023
            p = target(z)  # noqa: B023
            pull = kernel * (p - q)
            g = -(alpha + 1) / alpha * (pull.T @ z - pull.sum(axis=0)[:, None] * centres)  # noqa: B023
            return np.append(g.ravel(), (p * np.log(np.maximum(p, 1e-300) / np.maximum(q, 1e-300))).sum())

        for step in range(steps):
            got = added(data, slope, centres.size + 1)
            g, kl = got[:-1].reshape(centres.shape) / rows, got[-1] / rows
            if step == 0:
                history.append((r, 0, float(kl)))
            tries = centres - lengths[:, None, None] * g

            def divergence(b: pa.RecordBatch) -> np.ndarray:
                z = matrix(b.column(0), wide)
                p = target(z)  # noqa: B023
                return np.array([(p * np.log(np.maximum(p, 1e-300) / np.maximum(soft(z, c, alpha)[0], 1e-300))).sum() for c in tries])  # noqa: B023

            found = added(data, divergence, len(lengths)) / rows
            best = int(np.argmin(found))
            if found[best] >= kl:
                break
            centres = tries[best]
            history.append((r, step + 1, float(found[best])))
        moved = added(data, lambda b: np.array([(soft(z := matrix(b.column(0), wide), base, alpha)[0].argmax(axis=1) != soft(z, centres, alpha)[0].argmax(axis=1)).sum()], float), 1)[0]  # noqa: B023
        if moved < least * rows:
            break
    return centres, points.sparkSession.createDataFrame(history, "round int, step int, kl double"), float(first.summary.trainingCost)
