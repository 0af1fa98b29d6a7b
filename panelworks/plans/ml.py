"""Model plans on Spark ML: trees, clusters, calibration, importances, feature selection."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators.explain import hash_split
from panelworks.operators.scoring import dual_rank, percentiles
from panelworks.operators.stats import auc
from panelworks.session import materialise


def _stages(features: Sequence[str], model) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features_", handleInvalid="keep"), model])


def with_validation(df: DataFrame, key: str = "id", share: float = 0.2, seed: int = 42, to: str = "validation_") -> DataFrame:
    """``to``: true for the hashed share of rows that early stopping watches; a row's part depends on its key only."""
    return df.withColumn(to, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < int(share * 10_000))


def _finite(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features as finite doubles in the same order: nulls and NaN become the greatest double, infinities the outermost ones.

    The trees refuse to be fitted to other values. In prediction a missing value is at or below
    no threshold and goes right, as the greatest double does here.
    """
    most = F.lit(sys.float_info.max)
    return df.withColumns({f: F.greatest(F.least(F.coalesce(F.col(f).cast("double"), most), most), -most) for f in features})


def _boosted(kind, train: DataFrame, features: Sequence[str], label: str, rounds: int, depth: int, seed: int, validation: str | None, tolerance: float) -> PipelineModel:
    """Boosted trees over an assembler; missing values of the features are fitted as ones that go right at every split."""
    trees = kind(featuresCol="features_", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, validationTol=tolerance)
    if validation is not None:
        trees = trees.setValidationIndicatorCol(validation)
    return _stages(features, trees).fit(_finite(train, features))


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, *, rounds: int = 20, depth: int = 4, seed: int = 42, validation: str | None = None, tolerance: float = 0.01) -> PipelineModel:
    """Gradient-boosted regression trees.

    ``validation`` names a boolean column (:func:`with_validation`): its rows are not fitted, and
    boosting stops when their loss no longer falls by ``tolerance``, so ``rounds`` is a limit.
    """
    return _boosted(GBTRegressor, train, features, target, rounds, depth, seed, validation, tolerance)


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, *, rounds: int = 20, depth: int = 4, seed: int = 42, validation: str | None = None, tolerance: float = 0.01) -> PipelineModel:
    """Gradient-boosted classification trees; ``validation`` as in :func:`fit_regressor`."""
    return _boosted(GBTClassifier, train, features, label, rounds, depth, seed, validation, tolerance)


def predict(model: PipelineModel, df: DataFrame, to: str) -> DataFrame:
    """``to``: the probability of class 1, or the predicted value of a regressor."""
    names = df.columns
    inner = model.transform(df.select(F.struct(*names).alias("row_"), *model.stages[0].getInputCols()))
    value = vector_to_array("probability")[1] if "probability" in inner.columns else F.col("prediction")
    return inner.select("row_.*", value.alias(to))


def two_phase(train: DataFrame, sites: DataFrame, features: Sequence[str], label: str, target: str, *, rank: bool = False, key: str = "id") -> DataFrame:
    """Sites with ``probability`` and ``predicted_<target>``: classify, then regress on the positive rows, score all.

    ``rank`` adds ``probability_rank`` and ``predicted_<target>_rank``, 1 being the highest, ties by key.
    """
    classifier = fit_classifier(train, features, label)
    regressor = fit_regressor(train.where(F.col(label) == 1), features, target)
    scored = predict(regressor, predict(classifier, sites, "probability"), f"predicted_{target}")
    return dual_rank(scored, "probability", f"predicted_{target}", key) if rank else scored


def residual_interval(scored: DataFrame, target: str, predicted: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """``low``, ``high``, ``width``: the prediction plus quantiles of the residuals of labelled rows."""
    q = percentiles(scored.where(F.col(target).isNotNull()), F.col(target) - F.col(predicted), (low, high), "q_")
    out = scored.crossJoin(F.broadcast(q))  # one row
    return out.withColumn("low", F.col(predicted) + F.col("q_")[0]).withColumn("high", F.col(predicted) + F.col("q_")[1]).withColumn("width", F.col("high") - F.col("low")).drop("q_")


def segments(df: DataFrame, vector: str, k: int, *, least: int = 1, seed: int = 42) -> DataFrame:
    """(id, cluster): k-means of an array column; clusters below ``least`` rows are dropped, numbers go by size."""
    rows = df.select("id", array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    found = KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").alias("c_"))
    sizes = found.groupBy("c_").agg(F.count("*").alias("n_")).where(F.col("n_") >= least)
    from pyspark.sql import Window as W

    order = sizes.select("c_", (F.row_number().over(W.orderBy(F.desc("n_"), "c_")) - 1).alias("cluster"))  # at most k rows
    return found.join(F.broadcast(order), "c_").select("id", "cluster")


def silhouette(df: DataFrame, vector: str, cluster: str) -> float:
    """Silhouette of a clustering by squared Euclidean distance."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(cluster).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(rows)


def isotonic(calibration: DataFrame, scores: DataFrame, label: str, probability: str, to: str = "calibrated") -> DataFrame:
    """``to``: isotonic calibration fitted on one table and applied to another, within [0, 1]; ``is_calibrated``.

    Without rows to fit on the raw value stands and ``is_calibrated`` is false.
    """
    if calibration.isEmpty():
        return scores.withColumn(to, F.col(probability)).withColumn("is_calibrated", F.lit(False))
    rows = calibration.select(F.col(label).cast("double").alias("label"), F.col(probability).alias("features"))
    model = IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)
    out = model.setPredictionCol("raw_").transform(scores.withColumn("features", F.col(probability))).drop("features")
    return out.withColumn(to, F.least(F.greatest("raw_", F.lit(0.0)), F.lit(1.0))).drop("raw_").withColumn("is_calibrated", F.lit(True))


def platt(calibration: DataFrame, scores: DataFrame, label: str, probability: str, to: str = "calibrated") -> DataFrame:
    """``to``: a logistic curve over the raw value, fitted on one table and applied to another; ``is_calibrated``.

    The slope has the unit ridge penalty that is usual for it. Without rows to fit on the raw
    value stands and ``is_calibrated`` is false.
    """
    n = calibration.where(F.col(label).isNotNull() & F.col(probability).isNotNull()).count()
    if not n:
        return scores.withColumn(to, F.col(probability)).withColumn("is_calibrated", F.lit(False))
    rows = calibration.dropna(subset=[label, probability]).select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(F.col(probability).cast("double"))).alias("features"))
    fit = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    raw = F.lit(float(fit.coefficients[0])) * F.col(probability) + F.lit(float(fit.intercept))
    return scores.withColumn(to, 1 / (1 + F.exp(-raw))).withColumn("is_calibrated", F.lit(True))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0 to k - 1 in equal shares, in the order of a keyed hash."""
    return hash_split(df, key, [1 / k] * k, seed).withColumnRenamed("part", "fold")


def cross_validate(df: DataFrame, features: Sequence[str], label: str, *, key: str = "id", k: int = 5, seed: int = 42, rounds: int = 10) -> DataFrame:
    """(fold, n_train, n_test, auc): each fold is scored by a classifier that was fitted on the others."""
    rows = materialise(folds(df, key, k, seed), "folds")
    out = []
    for fold in range(k):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        scored = predict(fit_classifier(train, features, label, rounds=rounds), test, "p_")
        out.append((fold, train.count(), test.count(), auc(scored, label, "p_").first()[0]))
    return df.sparkSession.createDataFrame(out, "fold int, n_train long, n_test long, auc double")


def learning_curve(df: DataFrame, features: Sequence[str], label: str, *, key: str = "id", fractions: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), seed: int = 42, rounds: int = 10) -> DataFrame:
    """(fraction, n_train, auc) on a fixed fifth of the rows, from growing parts of the others (each holds the ones before)."""
    rows = materialise(folds(df, key, 5, seed), "folds")
    test, rest = rows.where("fold = 4"), rows.where("fold < 4").drop("fold")
    ordered = materialise(hash_split(rest, key, [0.01] * 100, seed + 1), "parts")
    out = []
    for f in fractions:
        train = ordered.where(F.col("part") < round(f * 100))
        out.append((float(f), train.count(), auc(predict(fit_classifier(train, features, label, rounds=rounds), test, "p_"), label, "p_").first()[0]))
    return df.sparkSession.createDataFrame(out, "fraction double, n_train long, auc double")


def save_artifacts(path: str, model: PipelineModel, tables: Mapping[str, DataFrame]) -> None:
    """A fitted model and the fitted tables that go with it (scalers, vocabularies, thresholds), under one folder."""
    model.write().overwrite().save(f"{path}/model")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/tables/{name}")


def load_artifacts(spark: SparkSession, path: str, tables: Sequence[str]) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """What :func:`save_artifacts` wrote."""
    return PipelineModel.load(f"{path}/model"), {name: spark.read.parquet(f"{path}/tables/{name}") for name in tables}


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, key: str = "id", repeats: int = 1, seed: int = 42) -> DataFrame:
    """(feature, importance): loss of AUC when a column's values are dealt to other rows.

    The rows are numbered once, in the order of a keyed hash; a shuffled column is the column
    of the row some places further on in that circle, another number of places each time.
    """
    from panelworks.operators.scoring import _numbered

    base = auc(predict(model, df, "p_"), label, "p_").first()[0]
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    numbered = materialise(_numbered(df, order, "at_"), "permuted")
    n, rng, rows = numbered.count(), np.random.default_rng(seed), []
    for f in features:
        drops = []
        for _ in range(repeats):
            ahead = int(rng.integers(1, n)) if n > 1 else 0
            other = numbered.select((F.pmod(F.col("at_") - 1 + ahead, F.lit(max(n, 1))) + 1).alias("at_"), f)
            drops.append(base - auc(predict(model, numbered.drop(f).join(other, "at_"), "p_"), label, "p_").first()[0])
        rows.append((f, float(np.mean(drops))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def shap_select(shap: DataFrame, target: str, features: Sequence[str], *, level: float = 0.05) -> DataFrame:
    """(feature, t, p): features that stay when the target is regressed on Shapley columns.

    Features whose coefficient is negative go first (the most negative t at a time), then the
    one of the lowest t while its p is at or above ``level``. One normal-equation fit a step.
    Columns without variance explain nothing and are left out from the start.
    """
    spread = shap.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    left = [f for f in features if spread[f]]
    t: list[float] = []
    p: list[float] = []
    while left:
        rows = VectorAssembler(inputCols=left, outputCol="features_").transform(shap)
        fit = LinearRegression(featuresCol="features_", labelCol=target, solver="normal").fit(rows).summary
        t, p = list(fit.tValues)[: len(left)], list(fit.pValues)[: len(left)]
        worst = int(np.argmin(t))
        if t[worst] >= 0 and p[worst] < level:
            break
        left.pop(worst)
    kept = [(f, float(a), float(b)) for f, a, b in zip(left, t, p)] if left else []
    return shap.sparkSession.createDataFrame(kept, "feature string, t double, p double")


def lasso_path(df: DataFrame, features: Sequence[str], target: str, lambdas: Sequence[float]) -> DataFrame:
    """(penalty, feature, coefficient) of L1 regressions along log-spaced penalties."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features_").transform(df).cache()
    out = []
    for penalty in lambdas:
        fit = LinearRegression(featuresCol="features_", labelCol=target, elasticNetParam=1.0, regParam=float(penalty)).fit(rows)
        out += [(float(penalty), f, float(c)) for f, c in zip(features, fit.coefficients.toArray())]
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "penalty double, feature string, coefficient double")


def log_spaced(low: float, high: float, n: int) -> list[float]:
    """n penalties from low to high, evenly spaced in their logarithm."""
    return [float(x) for x in np.logspace(np.log10(low), np.log10(high), n)]
