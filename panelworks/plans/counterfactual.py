"""Counterfactuals over numeric ranges and categories: the fewest changes that lift a row over a cut, and their clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators.explain import name_cluster
from panelworks.operators.scoring import classify_tiers, column_percentiles, tier_distribution, tier_shift
from panelworks.plans import ml
from panelworks.plans.treeshap import Forest
from panelworks.session import materialise


@dataclass(frozen=True)
class Action:
    """A feature that may change, the values that it may take, and the span that a numeric change is measured by (None: a category)."""

    feature: str
    values: tuple[float, ...]
    span: float | None = None

    def cost(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Share of the span for numbers, 1 for categories and from a missing value."""
        if self.span is None:
            return np.ones(np.broadcast(before, after).shape)
        return np.where(np.isnan(before), 1.0, np.abs(after - before) / self.span)


def actions_from(rows: DataFrame, numeric: Mapping[str, tuple[float, float] | None], categorical: Mapping[str, Sequence[float]], steps: int = 8) -> list[Action]:
    """Actions of a table: ``steps`` quantiles of each numeric column within its permitted range (None: any), and the given codes."""
    found = column_percentiles(rows, list(numeric), [k / (steps - 1) for k in range(steps)]).first() if numeric else {}
    out = []
    for name, ends in numeric.items():
        points = found[f"p_{name}"] or []
        low, high = ends if ends else (points[0], points[-1]) if points else (0.0, 0.0)
        values = sorted({min(max(float(v), low), high) for v in points})
        out.append(Action(name, tuple(values), max(high - low, 1e-12)))
    return out + [Action(name, tuple(map(float, codes))) for name, codes in categorical.items()]


def _probability(forest: Forest, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * forest.predict(x)))


def best_changes(forest: Forest, row: np.ndarray, actions: Sequence[Action], cut: float, most: int, beam: int) -> tuple[list[tuple[str, float, float]], float, float] | None:
    """(changes, probability, cost) that lift one row over the cut, or None.

    Level by level, every state of the beam gets one more change; states that are reached
    twice count once. On the first level where a state is over the cut, the cheapest one wins
    (ties: the highest probability, then the first in the order of actions and values). Else
    the ``beam`` states of the highest probability go on; while a level has no more, none is
    left out and the result is the best there is.
    """
    place = [forest.features.index(a.feature) for a in actions]
    # A state: for each action the number of its value, or -1 for none.
    states = np.full((1, len(actions)), -1, np.int64)
    for _ in range(min(most, len(actions))):
        grown = []
        for i, action in enumerate(actions):
            free = states[states[:, i] < 0]
            for v, value in enumerate(action.values):
                if value != row[place[i]]:
                    grown.append(free.copy())
                    grown[-1][:, i] = v
        states = np.unique(np.concatenate(grown), axis=0) if grown else states[:0]
        if not len(states):
            return None
        x = np.repeat(row[None, :], len(states), axis=0)
        cost = np.zeros(len(states))
        for i, action in enumerate(actions):
            made = states[:, i] >= 0
            if made.any():
                after = np.array(action.values)[states[made, i]]
                cost[made] += action.cost(row[place[i]], after)
                x[made, place[i]] = after
        p = _probability(forest, x)
        over = np.flatnonzero(p >= cut)
        if len(over):
            at = over[np.lexsort((over, -p[over], cost[over].round(12)))[0]]
            changes = [(a.feature, float(row[place[i]]), a.values[states[at, i]]) for i, a in enumerate(actions) if states[at, i] >= 0]
            return changes, float(p[at]), float(cost[at])
        states = states[np.lexsort((np.arange(len(p)), cost, -p))[:beam]]
    return None


def counterfactuals(forest: Forest, rows: DataFrame, actions: Sequence[Action], *, key: str = "id", cut: float = 0.5, most: int = 4, beam: int = 24) -> DataFrame:
    """(key, changes, probability, cost) of the rows below the cut that up to ``most`` changes lift over it.

    changes: (feature, before, after) for each. Only features with an action change. Rows over
    the cut, and rows that no such change lifts, are left out; null and repeated keys stay. The
    model is broadcast once; work and memory of a row depend on the beam and the actions alone.
    """
    if not forest.classifier:
        raise ValueError("a classifier's trees are needed")
    shared = rows.sparkSession.sparkContext.broadcast((forest, tuple(actions)))
    kind, names = rows.select(key).schema[0].dataType.simpleString(), list(forest.features)

    def run(batches):
        model, allowed = shared.value
        for b in batches:
            x = b[names].to_numpy(float)
            out = []
            for i in np.flatnonzero(_probability(model, x) < cut):
                found = best_changes(model, x[i], allowed, cut, most, beam)
                if found:
                    out.append((b["key_"].iloc[i], [{"feature": f, "before": u, "after": v} for f, u, v in found[0]], *found[1:]))
            yield pd.DataFrame(out, columns=["key_", "changes", "probability", "cost"])

    columns = [F.col(c).cast("double").alias(c) for c in names]
    schema = f"key_ {kind}, changes array<struct<feature:string,before:double,after:double>>, probability double, cost double"
    # A row costs milliseconds, so few bytes are much work: rows are spread by key, and adaptive execution must not join the parts.
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = rows.select(F.col(key).alias("key_"), *columns).repartition(parts, "key_")
    return spread.mapInPandas(run, schema).withColumnRenamed("key_", key)


def change_clusters(found: DataFrame, actions: Sequence[Action], k: int, *, least: int = 1, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """((key, cluster) of every row with changes, (cluster, n, centre, name, description)), largest cluster first.

    A row's vector has, for every action, the change as a share of its span (categories, and numbers
    that were missing before: 1, as they cost). Clusters below ``least`` rows are left out. The vectors
    are written once, as searching them is the dear part.
    """
    changed = F.map_from_entries(F.transform("changes", lambda c: F.struct(c["feature"], F.nanvl(c["after"] - c["before"], F.lit(None).cast("double")).alias("d"))))
    share = lambda a: F.coalesce(F.try_element_at("m_", F.lit(a.feature)) / a.span, F.lit(1.0)) if a.span else F.lit(1.0)
    parts = [F.when(F.map_contains_key("m_", a.feature), share(a)).otherwise(0.0) for a in actions]
    vectors = found.select(F.col(key).alias("id"), changed.alias("m_")).select("id", F.array(*parts).alias("vector"))
    vectors = materialise(vectors, "changes")
    members = ml.segments(vectors, "vector", k, least=least)
    mean = F.array(*[F.avg(F.col("vector")[i]) for i in range(len(actions))])
    centres = vectors.join(members, "id").groupBy("cluster").agg(F.count("*").alias("n"), mean.alias("centre"))
    name, text = name_cluster(F.col("centre"), [a.feature for a in actions])
    return members.withColumnRenamed("id", key), centres.select("cluster", "n", "centre", name.alias("name"), text.alias("description"))


def fleet_changes(scored: DataFrame, found: DataFrame, actions: Sequence[Action], *, probability: str = "p", k: int = 4, least: int = 1, success: float = 1.0) -> dict[str, DataFrame]:
    """The fleet's tiers, the change clusters of its low tiers, and the tiers after the clusters' interventions.

    Tables: ``tiers`` (scored rows with their tier), ``members`` (id, cluster), ``clusters``, ``shift``
    (tier, before, after). The largest cluster is carried out first.
    """
    tiers = classify_tiers(scored, probability)
    low = found.join(tiers.where("tier >= 3").select("id"), "id", "left_semi")
    members, clusters = change_clusters(low, actions, k, least=least)
    moves = clusters.select(F.col("cluster").alias("ord"), "n", F.lit(success).alias("rate"))
    return {"tiers": tiers, "members": members, "clusters": clusters, "shift": tier_shift(tier_distribution(tiers), moves)}
