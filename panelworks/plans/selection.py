"""Choosing features: presets of a method, one entry for all of them, and the summary of what was chosen."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.plans import descent, ml, treeshap


@dataclass(frozen=True)
class Selection:
    """method: ``none``, ``gates`` or ``path``. penalty: on open gates, or the (largest) one of the path.

    penalties: how many the path has. bound: what its hidden layer may use. sigma, threshold: noise
    of the gates, and the probability from which one counts as open. confirm: whether a feature
    must also carry significant Shapley values of a fitted model, at ``level``.
    """

    method: str = "none"
    penalty: float = 0.1
    penalties: int = 1
    bound: float = 10.0
    sigma: float = 0.5
    threshold: float = 0.5
    confirm: bool = False
    level: float = 0.05


#: The named settings.
PRESETS = {
    "none": Selection(),
    "stg_light": Selection("gates", penalty=0.05),
    "stg_aggressive": Selection("gates", penalty=0.3, confirm=True),
    "lassonet_standard": Selection("path", penalty=0.01),
    "lassonet_path": Selection("path", penalty=1.0, penalties=30),
    "shap_only": Selection(confirm=True),
    "hybrid_stg_shap": Selection("gates", penalty=0.1, confirm=True),
}


def _scores(df: DataFrame, features: Sequence[str], target: str, s: Selection, key: str, steps: int | None) -> list[tuple[str, float, bool]]:
    if s.method == "gates":
        fit = descent.fit_gates(df, features, target, key=key, penalty=s.penalty, sigma=s.sigma, **({"steps": steps} if steps else {}))
        return [(f, float(p), bool(p > s.threshold)) for f, p in zip(features, fit.open)]
    if s.method == "path":
        rising = ml.log_spaced(s.penalty / 100, s.penalty, s.penalties) if s.penalties > 1 else [s.penalty]
        rows = descent.hier_path(df, features, target, rising, key=key, bound=s.bound, **({"steps": steps} if steps else {})).collect()  # features x penalties
        loss = {r["penalty"]: r["loss"] for r in rows}
        # The largest penalty that loses at most a fifth of the target's variance (the loss is half of it) against the best one.
        chosen = max(p for p, x in loss.items() if x <= min(loss.values()) + 0.1)
        kept = {r["feature"]: r["kept"] for r in rows if r["penalty"] == chosen}
        return [(f, sum(r["kept"] for r in rows if r["feature"] == f) / len(loss), kept[f]) for f in features]
    if s.method == "none":
        return [(f, 1.0, True) for f in features]
    raise ValueError(f"unknown method {s.method}")


def select_features(df: DataFrame, features: Sequence[str], target: str, selection: Selection | str, *, key: str = "id", steps: int | None = None) -> DataFrame:
    """(feature, importance, selected, rank) by a :class:`Selection` or the name of a preset.

    importance: the probability of an open gate, the share of the path's penalties that keep the
    feature, or 1. rank: by importance, ties by name. ``steps`` shortens the fit.
    """
    s = PRESETS[selection] if isinstance(selection, str) else selection
    found = _scores(df, features, target, s, key, steps)
    left = [f for f, _, kept in found if kept]
    if s.confirm and left:
        rows = df.where(F.col(target).isNotNull())
        forest = treeshap.flatten(ml.fit_regressor(rows, left, target, rounds=8, depth=3))
        wide = treeshap.tree_shapley(forest, rows, key).groupBy(key).pivot("feature", left).agg(F.first("shap"))
        sure = {r["feature"] for r in ml.shap_select(wide.join(rows.select(key, target), key), target, left, level=s.level).collect()}
        found = [(f, x, kept and f in sure) for f, x, kept in found]
    order = sorted(found, key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(*r, i + 1) for i, r in enumerate(order)], "feature string, importance double, selected boolean, rank int")


def selection_summary(selected: DataFrame) -> DataFrame:
    """One row: n_total, n_selected, n_eliminated, selection_rate, and the features selected, eliminated, ten best and ten last, by rank."""
    names = lambda hit: F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("rank", "feature")))), lambda x: x["feature"])
    n, kept = F.count("*"), F.count_if("selected")
    one = selected.agg(n.alias("n_total"), kept.alias("n_selected"), (n - kept).alias("n_eliminated"), F.try_divide(kept, n).alias("selection_rate"), names(F.col("selected")).alias("selected"), names(~F.col("selected")).alias("eliminated"), names(F.lit(True)).alias("all_"))
    return one.withColumn("top_10", F.slice("all_", 1, 10)).withColumn("bottom_10", F.slice("all_", F.greatest(F.size("all_") - 9, F.lit(1)), 10)).drop("all_")


def eliminate(scores: DataFrame, *, score: str = "normalised", percentile: float = 10.0, keep: int = 5) -> DataFrame:
    """(feature, score, place) of the features to drop: the lowest ``percentile`` per cent of them, lowest first.

    At most a tenth of what lies above ``keep`` features goes at once (but one at least); at
    ``keep`` features or fewer none does. Ties go by name.
    """
    n = F.broadcast(scores.agg(F.count("*").alias("n_")))  # one row
    most = F.least(F.floor(F.col("n_") * percentile / 100), F.greatest(F.floor((F.col("n_") - keep) * 0.1), F.lit(1)))
    # A row for each feature: the set of features fits in one task.
    placed = scores.crossJoin(n).where(F.col("n_") > keep).withColumn("place", F.row_number().over(W.orderBy(score, "feature")))
    return placed.where(F.col("place") <= most).select("feature", score, "place")
