"""Queries: fitted models, their explanations and what follows from them. No SQL says the same of a fitted model."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.operators import explain, scoring, stats
from panelworks.plans import boosting, counterfactual, descent, ml, selection, treeshap
from panelworks.queries.base import R, people, query, rounded, sites, table
from panelworks.session import scratch_path

FEATURES = ["p", "acctbal", "lat", "lon", "active_months"]


def _modelled(spark, d):
    return people(spark, d).join(sites(spark, d).select("id", "total_revenue", "active_months"), "id", "left")


def _forest(spark, d):
    return treeshap.flatten(ml.fit_classifier(_modelled(spark, d).where("id % 5 <> 0"), FEATURES, "label", rounds=4, depth=3))


@query()
def tree_shapley(spark, d):
    """Exact values of a fitted classifier for every row and feature."""
    return treeshap.tree_shapley(_forest(spark, d), _modelled(spark, d))


@query()
def tier_drivers(spark, d):
    """The signed drivers of every tier, from exact values."""
    rows = _modelled(spark, d)
    tiers = scoring.classify_tiers(rows).select("id", F.col("tier").alias("cluster"))
    return treeshap.cluster_drivers(treeshap.tree_shapley(_forest(spark, d), rows), tiers)


@query()
def row_drivers(spark, d):
    """What raises and what lowers every row's prediction most."""
    return treeshap.row_drivers(treeshap.tree_shapley(_forest(spark, d), _modelled(spark, d)))


@query()
def shapley_store(spark, d):
    """Values of two thirds of the rows, then of all: the second call computes the last third only."""
    forest, rows = _forest(spark, d), _modelled(spark, d)
    store = treeshap.ShapleyStore(scratch_path(spark, "shapley"))
    _, first = store.values(forest, rows.where("id % 3 <> 0"))
    values, second = store.values(forest, rows)
    return values.withColumn("computed_before", F.lit(first)).withColumn("computed_now", F.lit(second))


@query()
def quantile_interval(spark, d):
    """Intervals between the fitted 10 % and 90 % quantiles."""
    rows = _modelled(spark, d)
    model = boosting.fit_quantiles(rows.where("id % 5 <> 0"), FEATURES, "q", rounds=4, depth=2)
    out = boosting.predict_quantiles(model, rows, ["low", "high"])
    return out.select("id", "q", "low", "high", (F.col("high") - F.col("low")).alias("width"))


@query()
def gbt_early_stop(spark, d):
    """A regressor that stops when hashed validation rows no longer gain; ``trees`` of at most 12 rounds."""
    rows = ml.with_validation(_modelled(spark, d))
    model = ml.fit_regressor(rows, FEATURES, "q", rounds=12, depth=3, validation="validation_")
    return ml.predict(model, rows, "predicted").select("id", "q", "predicted", F.col("validation_").alias("validation"), F.lit(model.stages[-1].getNumTrees).alias("trees"))


@query()
def two_phase_ranks(spark, d):
    """Classify, regress on the positive rows, and rank every row by both."""
    rows = _modelled(spark, d)
    return ml.two_phase(rows.where("id % 5 <> 0"), rows, ["p", "acctbal", "lat", "lon"], "label", "q", rank=True).select("id", "probability", "predicted_q", "probability_rank", "predicted_q_rank")


def _actions(rows):
    return counterfactual.actions_from(rows, {"p": (0.2, 1.0), "acctbal": None, "lat": None}, {"active_months": [3, 12, 24]}, steps=5)


def _found(spark, d):
    rows = _modelled(spark, d)
    return counterfactual.counterfactuals(_forest(spark, d), rows, _actions(rows), most=3, beam=16)


@query()
def counterfactual_search(spark, d):
    """The fewest changes of three numbers and a category that lift each row over even odds."""
    return _found(spark, d)


@query()
def change_clusters(spark, d):
    """Clusters of these changes, named by what they have in common."""
    rows = _modelled(spark, d)
    return counterfactual.change_clusters(_found(spark, d), _actions(rows), 4)[1]


@query()
def fleet_changes(spark, d):
    """Tiers before and after the clusters' interventions."""
    rows, forest = _modelled(spark, d), _forest(spark, d)
    margin = treeshap.tree_shapley(forest, rows).groupBy("id").agg(F.sum("shap").alias("m"))
    scored = margin.select("id", (1 / (1 + F.exp(-2 * (F.col("m") + forest.base)))).alias("p"))
    return counterfactual.fleet_changes(scored, _found(spark, d), _actions(rows))["shift"]


@query()
def refined_clusters(spark, d):
    """Embeddings in ten clusters: k-means, refined against the target distribution."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    centres, _, _ = descent.refine_clusters(e, 10, starts=2, rounds=2, steps=2)
    return explain.soft_assign(e, centres.tolist()).select("id", stats.argmax(F.col("q")).alias("cluster"), F.array_max("q").alias("share"))


@query()
def gate_selection(spark, d):
    """Which columns of the order lines the extended price needs, by stochastic gates."""
    li = table(spark, d, "lineitem").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    names = ["l_quantity", "l_discount", "l_tax", "l_suppkey", "l_linenumber"]
    model = descent.fit_gates(li, names, "l_extendedprice", steps=24, rate=0.15)
    return spark.createDataFrame([(f, float(w), float(g), float(p)) for f, w, g, p in zip(names, model.weight, model.gate, model.open)], "feature string, weight double, gate double, open double")


@query()
def hierarchical_path(spark, d):
    """Columns that a linear model with a hidden layer drops as the penalty rises."""
    return descent.hier_path(_modelled(spark, d), FEATURES, "q", [0.05, 0.3, 1.0], start=12, steps=6)


@query()
def embedding_regressor(spark, d):
    """A residual network over segment and nation embeddings, predicted for every row."""
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    rows = _modelled(spark, d).withColumn("segment_code", F.coalesce(F.array_position(segments, F.col("segment")), F.lit(0)))
    net = descent.fit_embeddings(rows, ["p", "acctbal", "active_months"], ["segment_code", "nation"], "q", epochs=12)
    return descent.predict_embeddings(net, rows, "predicted").select("id", "q", "predicted")


@query()
def feature_selection(spark, d):
    """A preset's choice among the columns, summed up."""
    return selection.selection_summary(selection.select_features(_modelled(spark, d), FEATURES, "q", "hybrid_stg_shap", steps=16))


@query(f"""WITH g AS (SELECT p_brand AS feature, 0.4 * abs(arg_max(p_size, p_partkey)) + 0.3 / (var_pop(p_size) + 1e-3) / 1000 + 0.2 * avg(abs(p_retailprice)) + 0.1 * least(count(*) / 100.0, 1) AS s FROM part GROUP BY 1),
n AS (SELECT feature, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS v, count(*) OVER () AS n FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY v, feature) AS place FROM n WHERE n > 5)
SELECT feature, {R('v', 5)} AS normalised, CAST(place AS INTEGER) AS place FROM r WHERE place <= least(floor(n * 0.2), greatest(floor((n - 5) * 0.1), 1))""")
def gradient_elimination(spark, d):
    h = table(spark, d, "part").select(F.col("p_brand").alias("feature"), F.col("p_partkey").alias("epoch"), F.col("p_size").cast("double").alias("weight"), F.col("p_retailprice").alias("gradient"))
    return rounded(selection.eliminate(explain.gradient_scores(h), percentile=20.0), 5)
