"""Models fitted by added gradients: formulas against finite differences and brute force, fits against planted truths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.plans import descent, ml


def frame(spark, x, **more):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])]).assign(id=np.arange(len(x)), **more))


def numeric_gradient(f, at, step=1e-6):
    return np.array([(f(at + step * e) - f(at - step * e)) / (2 * step) for e in np.eye(len(at))])


def test_gate_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, w, gates = rng.normal(size=(30, 4)), rng.normal(size=30), rng.normal(size=4), rng.random((3, 4))
    got = descent.gate_gradient(x, y, w, gates)
    for m in range(3):
        slope = numeric_gradient(lambda v: ((x @ (gates[m] * v) - y) ** 2).sum() / 2, w)  # noqa: B023
        assert got[4 * m : 4 * m + 4] * gates[m] == pytest.approx(slope, rel=1e-4)
        assert got[12 + m] == pytest.approx(((x @ (gates[m] * w) - y) ** 2).sum())
    assert got[-1] == 30


def test_gates_open_for_the_planted_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 8))
    y = 2 * x[:, 1] - 1.5 * x[:, 5] + rng.normal(0, 0.3, 1200)
    model = descent.fit_gates(frame(spark, x, y=y), [f"f{i}" for i in range(8)], "y", steps=60, rate=0.15, penalty=0.1)
    assert {i for i in range(8) if model.gate[i] > 0.5} == {1, 5}
    assert all(model.gate[i] < 0.25 for i in range(8) if i not in (1, 5)) and min(model.open[[1, 5]]) > max(np.delete(model.open, [1, 5]))
    assert model.losses[-1] < 0.5 * model.losses[0]


@pytest.mark.parametrize("seed", range(4))
def test_hier_prox_is_the_minimiser(seed):
    rng = np.random.default_rng(seed)
    v, u = rng.normal(size=6), rng.normal(size=(6, 3)) * 2
    penalty, bound = rng.random() * 1.5, 0.3 + rng.random() * 2
    beta, theta = descent.hier_prox(v, u, penalty, bound)
    assert (np.abs(theta) <= bound * np.abs(beta)[:, None] + 1e-12).all()
    for j in range(6):
        # For a given beta the best theta is u cut to the bound; beta is tried on a fine grid.
        grid = np.concatenate([np.linspace(-6, 6, 120_001), [0.0, beta[j]]])
        cost = (grid - v[j]) ** 2 / 2 + (np.maximum(np.abs(u[j]) - bound * np.abs(grid)[:, None], 0) ** 2).sum(axis=1) / 2 + penalty * np.abs(grid)
        own = (beta[j] - v[j]) ** 2 / 2 + ((theta[j] - u[j]) ** 2).sum() / 2 + penalty * abs(beta[j])
        assert own <= cost.min() + 1e-7


def test_path_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(25, 3)), rng.normal(size=25)
    at = rng.normal(size=3 + 6 + 2)

    def loss(p):
        return ((x @ p[:3] + np.maximum(x @ p[3:9].reshape(3, 2), 0) @ p[9:] - y) ** 2).sum() / 2

    got = descent._path_sums(x, y, at[:3], at[3:9].reshape(3, 2), at[9:])
    assert got[:-2] == pytest.approx(numeric_gradient(loss, at), rel=1e-4, abs=1e-4)
    assert got[-2:] == pytest.approx([loss(at), 25])


def test_path_drops_features_in_turn(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 6))
    y = 3 * np.abs(x[:, 2]) + 1.5 * x[:, 4] + rng.normal(0, 0.2, 1500)
    names = [f"f{i}" for i in range(6)]
    out = descent.hier_path(frame(spark, x, y=y), names, "y", [0.05, 0.2, 0.6, 3.0], start=60, steps=12).toPandas()
    kept = [set(out[(out.penalty == p) & out.kept].feature) for p in sorted(out.penalty.unique())]
    assert all(b <= a for a, b in zip(kept, kept[1:])) and not kept[-1]
    # Only the hidden layer can use the one of the absolute value; both true ones outlast the noise.
    assert {"f2", "f4"} in kept
    assert (out.loss.groupby(out.penalty).first().diff().dropna() > -1e-3).all()


@pytest.mark.parametrize("kind", ["huber", "bce"])
def test_embedding_gradient_is_that_of_the_loss(kind):
    rng = np.random.default_rng(5)
    net = descent.EmbeddingNet(("a", "b"), ("c", "d"), (3, 2), 2, 4, kind, 3.0, np.empty(0), np.zeros(3), np.ones(3))
    size = sum(int(np.prod(s)) for s in net.shapes())
    at = rng.normal(0, 0.5, size)
    codes, x = np.column_stack([rng.integers(0, 3, 20), rng.integers(0, 2, 20)]), rng.normal(size=(20, 2))
    y = rng.normal(size=20) * 2 if kind == "huber" else rng.integers(0, 2, 20).astype(float)
    got = net.sums(at, codes, x, y)
    assert got[:-2] == pytest.approx(numeric_gradient(lambda p: net.sums(p, codes, x, y)[-2], at), rel=2e-3, abs=1e-4)
    assert got[-1] == 20


def test_embeddings_beat_a_linear_model_on_an_interaction(spark):
    rng = np.random.default_rng(6)
    n = 2400
    x, c = rng.normal(size=(n, 1)), rng.integers(0, 4, n)
    y = np.where(c % 2 == 0, 2.0, -2.0) * x[:, 0] + (c == 3) + rng.normal(0, 0.2, n)
    df = frame(spark, x, y=y, c=c)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    net = descent.fit_embeddings(train, ["f0"], ["c"], "y", epochs=50)
    assert net.losses[-1] <= net.losses[0] and net.rates == sorted(net.rates, reverse=True)
    error = descent.predict_embeddings(net, test, "p").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2.0))).first()[0]
    plain = ml.lasso_path(train.withColumn("c", F.col("c").cast("double")), ["f0", "c"], "y", [1e-6]).toPandas().set_index("feature")["coefficient"]
    fitted = test.toPandas()
    linear = ((fitted.y - fitted.f0 * plain["f0"] - fitted.c * plain["c"]) ** 2).mean()
    assert error < 0.3 * linear


def test_embeddings_of_classes_and_odd_rows(spark):
    rows = [(i, float(i % 7), i % 3 if i % 5 else None, int(i % 3 == 1)) for i in range(300)] + [(900, None, 9, None)]
    df = spark.createDataFrame(rows, "id long, x double, c int, label int")
    net = descent.fit_embeddings(df, ["x"], ["c"], "label", kind="bce", epochs=6)
    out = {r["id"]: r["p"] for r in descent.predict_embeddings(net, df, "p").collect()}
    assert len(out) == 301 and all(0 < p < 1 for p in out.values())
    assert net.sizes == (10,)
    empty = descent.fit_embeddings(df.where("id < 0"), ["x"], [], "label", epochs=1)
    assert descent.predict_embeddings(empty, df, "p").count() == 301


def test_refined_clusters_equal_numpy(spark):
    rng = np.random.default_rng(7)
    z = np.concatenate([rng.normal(m, 0.7, (120, 3)) for m in (0, 2, 4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, vector array<double>")
    centres, history, cost = descent.refine_clusters(df, 3, rounds=2, steps=3, least=0.0)
    steps = [tuple(r) for r in history.orderBy("round", "step").collect()]
    for (r, _, kl), (s, k, after) in zip(steps, steps[1:]):
        assert s != r or after < kl
    # The same rounds in numpy from the same start.
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.select(array_to_vector("vector").alias("features"))
    fits = [KMeans(k=3, seed=42 + i).fit(ready) for i in range(4)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    assert cost == pytest.approx(best.summary.trainingCost)
    now, plain = np.array(list(best.clusterCenters())), []
    for r in range(2):
        q = descent.soft(z, now, 1.0)[0]
        p = q**2 / q.sum(axis=0)
        p /= p.sum(axis=1, keepdims=True)
        kl = lambda c: (p * np.log(p / descent.soft(z, c, 1.0)[0])).sum() / len(z)  # noqa: B023, E731
        plain.append((r, 0, kl(now)))
        for step in range(3):
            g = numeric_gradient(lambda v: kl(v.reshape(now.shape)), now.ravel(), 1e-5).reshape(now.shape)  # noqa: B023
            tries = [now - n * g for n in (4.0, 1.0, 0.25, 0.0625)]
            found = [kl(c) for c in tries]
            if min(found) >= kl(now):
                break
            now = tries[int(np.argmin(found))]
            plain.append((r, step + 1, min(found)))
    assert [s[:2] for s in steps] == [s[:2] for s in plain]
    assert [s[2] for s in steps] == pytest.approx([s[2] for s in plain], rel=1e-4)
    # Starts of equal cost may number the clusters otherwise.
    assert centres[centres[:, 0].argsort()] == pytest.approx(now[now[:, 0].argsort()], abs=1e-3)
