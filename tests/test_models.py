"""Fitted models against plain re-computation: exact Shapley values, their store, quantile trees, early stopping, ranks."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.plans import boosting, counterfactual, ml, selection, treeshap

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((400, 4)), 2)
    y = np.where(x[:, 0] > 0.5, x[:, 1], 1 - x[:, 1]) + x[:, 2] + rng.normal(0, 0.05, 400)
    df = pd.DataFrame(x, columns=NAMES).assign(id=np.arange(400), y=y, label=(y > 1).astype(int))
    return spark.createDataFrame(df).cache()


@pytest.fixture(scope="module")
def models(table):
    return ml.fit_regressor(table, NAMES, "y", rounds=4, depth=3), ml.fit_classifier(table, NAMES, "label", rounds=3, depth=4)


def tree_value(node, x, known):
    """A tree's value when only ``known`` features are known: both sides by training weight elsewhere."""
    if "Leaf" in node.getClass().getSimpleName():
        return node.prediction()
    j, cut = node.split().featureIndex(), node.split().threshold()
    left, right = node.leftChild(), node.rightChild()
    if j in known:
        return tree_value(left if x[j] <= cut else right, x, known)
    n = node.impurityStats().count()
    return sum(c.impurityStats().count() / n * tree_value(c, x, known) for c in (left, right))


@pytest.mark.parametrize("which", [0, 1])
def test_shapley_values_equal_all_subsets(table, models, which):
    model = models[which]
    ensemble, forest = model.stages[-1], treeshap.flatten(model)
    roots = [(w, t._java_obj.rootNode()) for w, t in zip(ensemble.treeWeights, ensemble.trees)]
    value = lambda x, known: sum(w * tree_value(r, x, known) for w, r in roots)
    rows = table.orderBy("id").limit(6).toPandas()[NAMES].to_numpy()
    rows = np.vstack([rows, [np.nan, 0.3, np.nan, 0.9]])
    got = forest.shapley(rows)
    for x, phi in zip(rows, got):
        for j in range(4):
            others = [k for k in range(4) if k != j]
            exact = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value(x, {*s, j}) - value(x, {*s})) for r in range(4) for s in itertools.combinations(others, r))
            assert phi[j] == pytest.approx(exact, abs=1e-9)
    assert forest.base == pytest.approx(value(rows[0], set()))
    assert forest.base + got.sum(axis=1) == pytest.approx(forest.predict(rows))


def test_shapley_values_add_up_to_the_model(table, models):
    regressor, classifier = models
    for model, to in ((regressor, lambda f: f), (classifier, lambda f: 1 / (1 + np.exp(-2 * f)))):
        forest = treeshap.flatten(model)
        sums = treeshap.tree_shapley(forest, table).groupBy("id").agg(F.sum("shap").alias("s"), F.count("*").alias("n")).toPandas().set_index("id")
        predicted = ml.predict(model, table, "m").select("id", "m").toPandas().set_index("id")["m"]
        assert (sums["n"] == 4).all()
        assert to(sums["s"] + forest.base).loc[predicted.index].to_numpy() == pytest.approx(predicted.to_numpy())
    assert forest.classifier and treeshap.flatten(classifier).digest == forest.digest != treeshap.flatten(regressor).digest


def test_drivers(spark):
    rows = [(1, "a", 0.5), (1, "b", -0.2), (1, "c", 0.1), (2, "a", -0.4), (2, "b", 0.0), (2, "c", 0.3), (3, "a", 0.2), (3, "b", -0.9), (3, "c", 0.0)]
    shap = spark.createDataFrame(rows, "id long, feature string, shap double")
    each = {r["id"]: (r["raises"], r["lowers"]) for r in treeshap.row_drivers(shap, 2).collect()}
    assert each == {1: (["a", "c"], ["b"]), 2: (["c"], ["a"]), 3: (["a"], ["b"])}
    clusters = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, cluster int")
    got = {(r["cluster"], r["rank"]): (r["feature"], r["direction"], r["n"], round(r["mean_shap"], 9), round(r["mean_abs"], 9)) for r in treeshap.cluster_drivers(shap, clusters, 2).collect()}
    assert got == {(0, 1): ("a", "+", 2, 0.05, 0.45), (0, 2): ("c", "+", 2, 0.2, 0.2), (1, 1): ("b", "-", 1, -0.9, 0.9), (1, 2): ("a", "+", 1, 0.2, 0.2)}


def test_store_computes_each_value_once(spark, table, models, tmp_path):
    forest, other = map(treeshap.flatten, models)
    store = treeshap.ShapleyStore(tmp_path.as_uri())
    some = table.where("id < 100")
    assert store.values(forest, some)[1] == 100
    values, computed = store.values(forest, table)
    assert computed == 300
    again, computed = store.values(forest, table)
    assert computed == 0
    plain = {(r["id"], r["feature"]): r["shap"] for r in treeshap.tree_shapley(forest, table).collect()}
    assert {(r["id"], r["feature"]): r["shap"] for r in again.collect()} == plain
    assert store.values(other, some)[1] == 100  # another model computes all
    assert store.values(forest, some.withColumn("a", F.when(F.col("id") < 7, 0.123).otherwise(F.col("a"))))[1] == 7  # changed rows too
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".staging")]


def plain_quantiles(x, y, alphas, rounds, depth, rate, bins, least):
    """The same trees by loops over rows."""
    edges = [np.unique(np.quantile(x[:, j], [k / bins for k in range(1, bins)])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    out = []
    for a in alphas:
        f = np.full(len(y), np.quantile(y, a))
        for _ in range(rounds):
            parts = [np.arange(len(y))]
            for _ in range(depth):
                grown = []
                for part in parts:
                    best, cut = 1e-9, None
                    slope = np.where(y[part] > f[part], 1.0, 0.0) - (1 - a)
                    for j in range(x.shape[1]):
                        for b in range(len(edges[j])):
                            left = binned[part, j] <= b
                            nl, nr = left.sum(), (~left).sum()
                            if min(nl, nr) >= least:
                                gain = slope[left].sum() ** 2 / nl + slope[~left].sum() ** 2 / nr - slope.sum() ** 2 / len(part)
                                if gain > best + 1e-9:
                                    best, cut = gain, (j, b)
                    if cut:
                        right = binned[part, cut[0]] > cut[1]
                        grown += [part[~right], part[right]]
                    else:
                        grown += [part, part[:0]]
                parts = grown
            step = np.zeros(len(y))
            for part in parts:
                if len(part):
                    step[part] = rate * np.quantile(y[part] - f[part], a)
            f = f + step
        out.append(f)
    return np.sort(np.column_stack(out), axis=1)


def test_quantile_trees_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.random((300, 2)), 2)
    y = np.round(x[:, 0] + rng.normal(0, 0.1 + x[:, 1], 300), 4)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(300), y=y))
    model = boosting.fit_quantiles(df, ["a", "b"], "y", rounds=3, depth=2, bins=8, least=15)
    got = boosting.predict_quantiles(model, df, ["low", "high"]).orderBy("id").toPandas()[["low", "high"]].to_numpy()
    assert got == pytest.approx(plain_quantiles(x, y, (0.1, 0.9), 3, 2, 0.2, 8, 15), abs=1e-9)


def test_quantile_trees_cover_held_out_rows(spark):
    rng = np.random.default_rng(5)
    n = 16_000
    x = rng.random((n, 2))
    y = 3 * x[:, 0] + rng.normal(0, 0.2 + 2 * (x[:, 1] > 0.5), n)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(n), y=y, v=np.arange(n) % 4 == 1))
    train = df.where("id % 4 < 2")
    model = boosting.fit_quantiles(train, ["a", "b"], "y", rounds=12, depth=3, rate=0.4, validation="v")
    held = boosting.predict_quantiles(model, df.where("id % 4 > 1"), ["low", "high"])
    one = held.agg(F.avg((F.col("y").between(F.col("low"), F.col("high"))).cast("double")).alias("c"), F.avg(F.when(F.col("b") > 0.5, F.col("high") - F.col("low"))).alias("wide"), F.avg(F.when(F.col("b") <= 0.5, F.col("high") - F.col("low"))).alias("narrow")).first()
    assert abs(one["c"] - 0.8) <= 0.02
    assert one["wide"] > 4 * one["narrow"]  # the true ratio is 11
    assert len(model.losses) <= 12 and all(len(t) <= len(model.losses) for t in model.trees)


def test_quantile_trees_on_odd_tables(spark):
    none = spark.createDataFrame([], "a double, y double")
    model = boosting.fit_quantiles(none, ["a"], "y", rounds=1, depth=1)
    some = spark.createDataFrame([(None, 1.0), (float("nan"), None), (0.5, 3.0)], "a double, y double")
    assert [tuple(r) for r in boosting.predict_quantiles(model, some, ["low", "high"]).select("low", "high").distinct().collect()] == [(0.0, 0.0)]
    model = boosting.fit_quantiles(some, ["a"], "y", rounds=2, depth=2, least=1)
    out = boosting.predict_quantiles(model, some, ["low", "high"]).collect()
    assert all(1.0 <= r["low"] <= r["high"] <= 3.0 for r in out)


def test_early_stopping_keeps_fewer_trees(spark):
    rng = np.random.default_rng(6)
    x = rng.random((1500, 3))
    df = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(1500), y=(x[:, 0] > 0.5) + rng.normal(0, 1.0, 1500))
    rows = ml.with_validation(spark.createDataFrame(df), "id", 0.3)
    train, test = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")
    loss = lambda m: ml.predict(m, test, "p").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2.0))).first()[0]
    stopped = ml.fit_regressor(train, ["a", "b", "c"], "y", rounds=25, validation="validation_")
    whole = ml.fit_regressor(train, ["a", "b", "c"], "y", rounds=25)
    assert stopped.stages[-1].getNumTrees < 25 == whole.stages[-1].getNumTrees
    assert loss(stopped) <= loss(whole)


def test_two_phase_ranks(table):
    out = ml.two_phase(table, table, NAMES, "label", "y", rank=True).toPandas()
    for c in ("probability", "predicted_y"):
        order = out.sort_values([c, "id"], ascending=[False, True])[f"{c}_rank"].tolist()
        assert order == list(range(1, 401))


def all_changes(forest, row, actions, cut, most):
    """The best changes by trying every set of actions and values."""
    place = [forest.features.index(a.feature) for a in actions]
    for n in range(1, most + 1):
        found = []
        for chosen in itertools.combinations(range(len(actions)), n):
            for values in itertools.product(*[[v for v in actions[i].values if v != row[place[i]]] for i in chosen]):
                x = row.copy()
                cost = 0.0
                for i, v in zip(chosen, values):
                    x[place[i]] = v
                    cost += 1.0 if actions[i].span is None else abs(v - row[place[i]]) / actions[i].span
                p = 1 / (1 + np.exp(-2 * forest.predict(x[None, :])[0]))
                if p >= cut:
                    found.append((round(cost, 9), -p))
        if found:
            return n, *min(found)
    return None


def test_counterfactuals_against_trying_all(spark, table, models):
    forest = treeshap.flatten(models[1])
    actions = [*counterfactual.actions_from(table, {"a": (0.0, 0.6), "b": None}, {"c": [0.0, 0.5, 1.0]}, steps=5)]
    assert actions[0].values[-1] <= 0.6 and actions[2].span is None
    got = {r["id"]: r for r in counterfactual.counterfactuals(forest, table, actions, cut=0.55, most=3, beam=10_000).collect()}
    tight = {r["id"]: r for r in counterfactual.counterfactuals(forest, table, actions, cut=0.55, most=3, beam=4).collect()}
    rows = table.select("id", *NAMES).orderBy("id").toPandas()
    lifted = 0
    for i, row in zip(rows["id"], rows[NAMES].to_numpy()):
        p = 1 / (1 + np.exp(-2 * forest.predict(row[None, :])[0]))
        best = all_changes(forest, row, actions, 0.55, 3) if p < 0.55 else None
        assert (i in got) == (best is not None)
        if best:
            lifted += 1
            r = got[i]
            assert (len(r["changes"]), round(r["cost"], 9)) == best[:2] and r["probability"] == pytest.approx(-best[2])
            assert {c["feature"] for c in r["changes"]} <= {"a", "b", "c"}
            assert all(c["before"] == row[NAMES.index(c["feature"])] != c["after"] for c in r["changes"])
            if i in tight:  # a narrow beam may need more, never give a row that is not over the cut
                assert tight[i]["probability"] >= 0.55 and len(tight[i]["changes"]) >= best[0]
    assert lifted > 50 and len(tight) > 0.9 * lifted


def test_counterfactuals_of_many_actions(spark):
    """Fourteen actions, of which two must change together: no set is left out of reach by their number."""
    rng = np.random.default_rng(1)
    names = [f"f{i}" for i in range(14)]
    x = rng.integers(0, 2, (3000, 14)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(3000), label=((x[:, 3] + x[:, 9]) == 2).astype(int)))
    forest = treeshap.flatten(ml.fit_classifier(df, names, "label", rounds=3, depth=3))
    found = counterfactual.counterfactuals(forest, df, [counterfactual.Action(n, (0.0, 1.0)) for n in names]).collect()
    assert len(found) == int(((x[:, 3] + x[:, 9]) < 2).sum())
    for r in found:
        assert {c["feature"]: c["after"] for c in r["changes"]} == {f"f{j}": 1.0 for j in (3, 9) if x[r["id"], j] == 0}


def test_change_clusters_and_fleet(spark):
    step = lambda f, b, a: {"feature": f, "before": b, "after": a}
    rows = [(i, [step("screens", 1.0, 5.0)], 0.7, 0.5) for i in range(6)] + [(10 + i, [step("open_24_hours", 0.0, 1.0)], 0.6, 1.0) for i in range(4)] + [(20, [step("screens", 1.0, 2.0), step("open_24_hours", 0.0, 1.0)], 0.6, 1.1)]
    found = spark.createDataFrame(rows, "id long, changes array<struct<feature:string,before:double,after:double>>, probability double, cost double")
    actions = [counterfactual.Action("open_24_hours", (0.0, 1.0)), counterfactual.Action("screens", (1.0, 2.0, 5.0), 8.0)]
    members, clusters = counterfactual.change_clusters(found, actions, 2)
    got = {r["cluster"]: (r["n"], r["name"], [round(v, 9) for v in r["centre"]]) for r in clusters.collect()}
    assert got == {0: (6, "Screen Expansion", [0.0, 0.5]), 1: (5, "Extended Hours Initiative", [1.0, 0.025])}
    assert members.count() == 11
    scored = spark.createDataFrame([(i, 0.55 if i < 3 else 0.2) for i in range(6)] + [(10 + i, 0.9) for i in range(4)] + [(20, 0.3)], "id long, p double")
    report = counterfactual.fleet_changes(scored, found, actions, k=2)
    assert report["members"].count() == 7  # rows of the first tier need no change
    assert {r["tier"]: (r["before"], r["after"]) for r in report["shift"].collect()} == {1: (4, 4), 2: (0, 3), 3: (3, 2), 4: (4, 2)}


def test_importance_of_a_useless_feature_is_least(spark):
    rng = np.random.default_rng(9)
    x = rng.random((1200, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(1200), label=((x[:, 0] + 0.4 * x[:, 1]) > 0.7).astype(int)))
    model = ml.fit_classifier(df, ["a", "b", "c"], "label", rounds=4, depth=3)
    got = {r["feature"]: r["importance"] for r in ml.permutation_importance(model, df, ["a", "b", "c"], "label", repeats=2).collect()}
    assert got["a"] > 2 * got["b"] > 0.02 and abs(got["c"]) < 0.01
    again = {r["feature"]: r["importance"] for r in ml.permutation_importance(model, df, ["a", "b", "c"], "label", repeats=2).collect()}
    assert again == pytest.approx(got)


def test_segments_and_lasso_on_planted_rows(spark):
    rng = np.random.default_rng(3)
    z = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (20, 2)), rng.normal(-5, 0.1, (4, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in ml.segments(df, "v", 3, least=10).collect()}
    assert got == {i: int(i >= 30) for i in range(50)}
    x = rng.normal(size=(500, 3))
    line = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=3 * x[:, 0] - x[:, 1]))
    path = {(round(r["penalty"], 3), r["feature"]): r["coefficient"] for r in ml.lasso_path(line, ["a", "b", "c"], "y", ml.log_spaced(0.001, 1.0, 2)).collect()}
    assert path[0.001, "a"] == pytest.approx(3, abs=0.05) and path[0.001, "b"] == pytest.approx(-1, abs=0.05)
    assert path[1.0, "b"] == path[1.0, "c"] == 0 < path[1.0, "a"] < 3


def test_selected_features_carry_weight(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 3))
    shap = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(flat=0.0, y=2 * x[:, 0] + x[:, 1] + rng.normal(0, 0.5, 800)))
    got = {r["feature"]: (r["t"], r["p"]) for r in ml.shap_select(shap, "y", ["a", "b", "c", "flat"]).collect()}
    assert set(got) == {"a", "b"} and all(t > 10 and p < 0.01 for t, p in got.values())


def test_selection_finds_the_planted_features(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(900, 5))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(id=np.arange(900), y=2 * x[:, 0] - 1.9 * x[:, 3] + rng.normal(0, 0.2, 900)))
    for chosen, steps in (("hybrid_stg_shap", 50), (selection.Selection("path", penalty=0.3, penalties=2, bound=1.0), 30), ("shap_only", None)):
        found = selection.select_features(df, list("abcde"), "y", chosen, steps=steps)
        assert {r["feature"] for r in found.where("selected").collect()} == {"a", "d"}
        assert [r["rank"] for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    one = selection.selection_summary(found).first()
    assert (one["n_total"], one["n_selected"], one["n_eliminated"], one["selection_rate"]) == (5, 2, 3, 0.4)
    assert (one["selected"], one["eliminated"], one["top_10"]) == (["a", "d"], ["b", "c", "e"], list("abcde"))
    with pytest.raises(ValueError, match="unknown method"):
        selection.select_features(df, ["a"], "y", selection.Selection("attention"))


def test_elimination_is_slow_and_stops(spark):
    df = spark.createDataFrame([(f"f{i:02d}", float(i // 2)) for i in range(40)], "feature string, normalised double")
    got = [tuple(r) for r in selection.eliminate(df, percentile=30.0, keep=10).orderBy("place").collect()]
    assert got == [("f00", 0.0, 1), ("f01", 0.0, 2), ("f02", 1.0, 3)]
    assert selection.eliminate(df, percentile=5.0, keep=10).count() == 2
    assert selection.eliminate(df.where("feature < 'f06'"), percentile=20.0, keep=5).count() == 1
    assert selection.eliminate(df.where("feature < 'f05'"), percentile=50.0, keep=5).count() == 0
    assert selection.eliminate(df.where("feature > 'g'")).count() == 0


def test_trees_are_fitted_with_missing_and_infinite_values(spark):
    rng = np.random.default_rng(4)
    x = rng.random(400)
    rows = [(i, None if i % 5 == 0 else float("nan") if i % 5 == 1 else float("inf") if i == 2 else float("-inf") if i == 3 else float(v), int(i % 5 < 2 or v > 0.5)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x double, label int").withColumn("y", F.col("label") * 3.0)
    forest = treeshap.flatten(ml.fit_classifier(df, ["x"], "label", rounds=4, depth=2))
    odds = forest.predict(np.array([[np.nan], [np.inf], [0.9], [0.1], [-np.inf]]))
    assert (odds[:3] > 0.3).all() and (odds[3:] < -0.3).all()  # a missing value goes right at every split
    shap = {r["id"]: r["shap"] for r in treeshap.tree_shapley(forest, df).collect()}
    assert len(shap) == 400 and shap[0] == shap[1] == pytest.approx(odds[0] - forest.base)
    rows = ml.with_validation(df)
    fitted = ml.fit_regressor(rows, ["x"], "y", rounds=12, depth=2, validation="validation_")
    got = {r["id"]: r["p_"] for r in ml.predict(fitted, rows, "p_").where("id < 2 OR id = 3").collect()}
    assert got[0] == got[1] > 2 > 1 > got[3]


def test_missing_values_only_are_no_split(spark):
    df = spark.createDataFrame([(i, None, float(i), int(i >= 20)) for i in range(40)], "id long, x double, z double, label int")
    forest = treeshap.flatten(ml.fit_classifier(df, ["x", "z"], "label", rounds=2, depth=2))
    assert set(forest.feature.ravel()) <= {-1, 1}


def test_change_clusters_of_missing_values(spark):
    step = lambda b, a: [{"feature": "screens", "before": b, "after": a}]
    rows = [(i, step(float("nan"), 5.0), 0.7, 1.0) for i in range(4)] + [(9, step(None, 2.0), 0.7, 1.0)] + [(10 + i, step(1.0, 2.0), 0.6, 0.1) for i in range(3)]
    found = spark.createDataFrame(rows, "id long, changes array<struct<feature:string,before:double,after:double>>, probability double, cost double")
    members, clusters = counterfactual.change_clusters(found, [counterfactual.Action("screens", (1.0, 2.0, 5.0), 8.0)], 2)
    assert {r["cluster"]: (r["n"], r["centre"]) for r in clusters.collect()} == {0: (5, [1.0]), 1: (3, [0.125])}
    assert members.count() == 8
