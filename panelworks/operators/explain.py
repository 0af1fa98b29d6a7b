"""Change vectors, soft clusters, feature scores, similarity and model explanations."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.session import materialise


def change_vectors(pairs: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(id, changes, vector) from columns ``<c>_from`` and ``<c>_to``; rows without a change are left out.

    Numeric columns give the difference, categorical ones 1.0 where the value differs.
    """
    parts = [F.coalesce(F.col(f"{c}_to") - F.col(f"{c}_from"), F.lit(0.0)).cast("double") for c in numeric]
    parts += [(~F.col(f"{c}_to").eqNullSafe(F.col(f"{c}_from"))).cast("double") for c in categorical]
    names = F.array(*[F.lit(c) for c in (*numeric, *categorical)])
    out = pairs.select("id", F.array(*parts).alias("vector"))
    changed = F.filter(F.arrays_zip(names.alias("name"), F.col("vector").alias("value")), lambda x: x["value"] != 0)
    return out.select("id", F.transform(changed, lambda x: x["name"]).alias("changes"), "vector").where(F.exists("vector", lambda v: v != 0))


#: What the first changed feature's name holds, and the cluster's name.
CLUSTER_NAMES = (
    (("hours", "24"), "Extended Hours Initiative"),
    (("screen",), "Screen Expansion"),
    (("programmatic",), "Programmatic Enablement"),
    (("emv", "nfc"), "Payment Modernization"),
)


def name_cluster(centre: Column, features: Sequence[str], least: float = 0.1) -> tuple[Column, Column]:
    """(name, description) of a cluster from its centre: the first three features with |value| above ``least``."""
    zipped = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("f"), centre.alias("v"))
    top = F.slice(F.transform(F.filter(zipped, lambda x: F.abs(x["v"]) > least), lambda x: x["f"]), 1, 3)
    first = F.lower(F.try_element_at(top, F.lit(1)))
    name = F.lit("Capability Enhancement")
    for words, label in reversed(CLUSTER_NAMES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(first, F.lit(w))
        name = F.when(hit, label).otherwise(name)
    name = F.when(F.size(top) == 0, "General Optimization").otherwise(name)
    text = F.when(F.size(top) == 0, "General operational improvements").otherwise(F.concat(F.lit("Primary changes: "), F.concat_ws("; ", top)))
    return name, text


def soft_assign(points: DataFrame, centres: Sequence[Sequence[float]], vector: str = "vector", alpha: float = 1.0) -> DataFrame:
    """``q``: Student-t soft assignment of an array column to the centres; rows of q sum to 1."""
    kernels = []
    for c in centres:
        d = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        kernels.append(F.pow(1 + d / alpha, F.lit(-(alpha + 1) / 2)))
    total = F.aggregate("k_", F.lit(0.0), lambda s, x: s + x)
    return points.withColumn("k_", F.array(*kernels)).withColumn("q", F.transform("k_", lambda x: x / total)).drop("k_")


def target_distribution(assigned: DataFrame, k: int) -> DataFrame:
    """``p``: q squared over the clusters' sums, each row normalised; sharper than q on average."""
    sums = assigned.agg(*[F.sum(F.col("q")[i]).alias(f"f{i}") for i in range(k)]).select(F.array(*[f"f{i}" for i in range(k)]).alias("f_"))
    out = assigned.crossJoin(F.broadcast(sums)).withColumn("w_", F.zip_with("q", "f_", lambda q, f: q * q / f))  # one row
    total = F.aggregate("w_", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("p", F.transform("w_", lambda x: x / total)).drop("w_", "f_")


def gradient_scores(history: DataFrame) -> DataFrame:
    """(feature, score, normalised) from rows (feature, epoch, weight, gradient).

    score = 0.4 |last weight| + 0.3 stability / 1000 + 0.2 mean |gradient| + 0.1 min(epochs / 100, 1),
    stability being 1 / (variance of the weights + 1e-3); normalised to [0, 1] over the features.
    """
    g = history.groupBy("feature").agg(
        F.abs(F.max_by("weight", "epoch")).alias("w_"),
        (1 / (F.var_pop("weight") + 1e-3)).alias("stab_"),
        F.avg(F.abs("gradient")).alias("mean_"),
        F.least(F.count("*") / 100, F.lit(1.0)).alias("conv_"),
    )
    g = g.select("feature", (0.4 * F.col("w_") + 0.3 * F.col("stab_") / 1000 + 0.2 * F.col("mean_") + 0.1 * F.col("conv_")).alias("score"))
    ends = g.agg(F.min("score").alias("lo_"), F.max("score").alias("hi_"))
    span = F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0.0))
    return g.crossJoin(F.broadcast(ends)).select("feature", "score", F.coalesce((F.col("score") - F.col("lo_")) / span, F.lit(0.0)).alias("normalised"))


def hash_split(df: DataFrame, key: str, shares: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``part`` 0, 1, ...: exact shares (cut to whole rows, the rest in the last part) in the order of a keyed hash.

    A share is taken as the fraction that it stands for (0.7 as 7 / 10), not as its binary neighbour.
    """
    from panelworks.operators.scoring import _numbered

    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
    numbered = _numbered(df, order, "at_")
    n = numbered.count()
    # The parts' last rows as constants: an expression over n for each part would grow with the square of their number.
    ends = itertools.accumulate(n * Fraction(s).limit_denominator(10**9) // 1 for s in shares[:-1])
    past = F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<bigint>"), lambda end: end < F.col("at_"))
    return numbered.withColumn("part", F.size(past)).drop("at_")


#: Reference rows of a block in the last search, about; reference rows of a cell in the first, for each of the k.
GOWER_BLOCK, GOWER_CELL = 4096, 4


def _k_least(found: Column, k: int) -> Column:
    """struct (total, taken, last) of the k least distances in an array of (d, w), w being how often each counts."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("taken"), F.lit(0.0).alias("last"))

    def add(s: Column, x: Column) -> Column:
        use = F.least(F.lit(k) - s["taken"], x["w"])
        return F.when(use > 0, F.struct((s["total"] + x["d"] * use).alias("total"), (s["taken"] + use).alias("taken"), x["d"].alias("last"))).otherwise(s)

    return F.aggregate(F.array_sort(found), start, add)


def gower_knn(queries: DataFrame, reference: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int = 10) -> DataFrame:
    """(id, score): 1 / (1 + mean Gower distance to the k nearest reference rows (rid)).

    Numeric parts are |a - b| over the column's range in the reference, 0 where one is null.
    Equal reference rows are one row with a count. Rows of the same categories meet in cells of
    the first two numeric columns, about ``GOWER_CELL`` times k to a cell; a result is final if
    neither a row beyond the searched cells nor one of another category can be nearer. Others
    are searched in cells 4 and 16 times as wide, and what is left then (rows far off, without
    a value, or of a rare category) is compared with the reference in blocks, merged per id.
    """
    columns, parts = [*numeric, *categorical], len(numeric) + len(categorical)
    ranges = reference.agg(*[F.min(c).alias(f"min_{c}") for c in numeric], *[F.nullif(F.max(c) - F.min(c), F.lit(0.0)).alias(f"range_{c}") for c in numeric], F.count("*").alias("n_ref_"))
    other = reference.groupBy(*[F.col(c).alias(f"r_{c}") for c in columns]).agg(F.least(F.count("*"), F.lit(k)).alias("w"))
    other = materialise(other.crossJoin(F.broadcast(ranges)), "gower")  # one row
    grid = list(numeric[:2])
    count = other.count()

    def distance(row: Callable[[str], Column]) -> Column:
        each = [F.coalesce(F.abs(F.col(c) - row(f"r_{c}")) / row(f"range_{c}"), F.lit(0.0)) for c in numeric]
        each += [(~F.col(c).eqNullSafe(row(f"r_{c}"))).cast("double") for c in categorical]
        return sum(each[1:], each[0]) / parts

    kind = lambda prefix: F.xxhash64(F.lit(0), *[F.col(f"{prefix}{c}") for c in categorical])
    left, found = queries.select("id", *columns), None
    placed = left.crossJoin(F.broadcast(ranges))
    place = lambda c, x: F.coalesce((F.col(x) - F.col(f"min_{c}")) / F.col(f"range_{c}"), F.when(F.col(x).isNotNull(), F.lit(0.0)))
    side = min(1.0, max(GOWER_CELL * k / max(count, 1), 1e-12) ** (1 / max(len(grid), 1)))
    for widen in (1, 4, 16) if grid else ():
        step = side * widen
        # A reference row without a value counts as near in that column: it is in cell null there.
        posted = other.select("*", kind("r_").alias("kind_"), *[F.floor(place(c, f"r_{c}") / step).alias(f"cell_{i}") for i, c in enumerate(grid)])
        near = placed.where(" AND ".join(f"`{c}` IS NOT NULL" for c in grid)).select("id", *columns, kind("").alias("kind_"), *[place(c, c).alias(f"u_{i}") for i, c in enumerate(grid)])
        own = [F.floor(F.col(f"u_{i}") / step) for i in range(len(grid))]
        edge = F.least(*[F.least(F.col(f"u_{i}") - (own[i] - 1) * step, (own[i] + 2) * step - F.col(f"u_{i}")) for i in range(len(grid))]) if len(grid) > 1 else F.least(F.col("u_0") - (own[0] - 1) * step, (own[0] + 2) * step - F.col("u_0"))
        bound = F.least(edge, F.lit(1.0)) if categorical else edge
        cells = near.withColumn("bound_", bound / parts)
        for i in range(len(grid)):
            cells = cells.withColumn(f"cell_{i}", F.explode(F.array(*[own[i] + d for d in (-1, 0, 1)], F.lit(None).cast("long"))))
        met = cells.alias("q").join(posted.alias("r"), (F.col("q.kind_") == F.col("r.kind_")) & F.expr(" AND ".join(f"q.cell_{i} <=> r.cell_{i}" for i in range(len(grid)))))
        best = met.select("id", "bound_", distance(F.col).alias("d"), "w").groupBy("id", "bound_").agg(_k_least(F.collect_list(F.struct("d", "w")), k).alias("b_"))
        done = best.where((F.col("b_.taken") >= k) & (F.col("b_.last") <= F.col("bound_"))).select("id", (1 / (1 + F.col("b_.total") / F.col("b_.taken"))).alias("score"))
        done = materialise(done, "gower")
        found = done if found is None else found.union(done)
        placed = placed.join(done.select("id"), "id", "left_anti")
        left = left.join(done.select("id"), "id", "left_anti")
        if left.isEmpty():
            return found
    block = F.pmod(F.xxhash64(*[f"r_{c}" for c in columns]), F.lit(max(1, -(-count // GOWER_BLOCK))))
    blocks = other.groupBy(block.alias("block_")).agg(F.collect_list(F.struct(*other.columns)).alias("rows_"))
    nearest = F.slice(F.array_sort(F.transform("rows_", lambda x: F.struct(distance(lambda c: x[c]).alias("d"), x["w"].alias("w")))), 1, k)
    merged = left.crossJoin(blocks).select("id", nearest.alias("n_")).groupBy("id").agg(_k_least(F.flatten(F.collect_list("n_")), k).alias("b_"))
    rest = merged.select("id", (1 / (1 + F.col("b_.total") / F.col("b_.taken"))).alias("score"))
    return rest if found is None else found.union(rest)


def top_features(shap: DataFrame, k: int = 10) -> DataFrame:
    """(feature, mean_abs): the k features of the largest mean |shap| in rows (row_id, feature, shap)."""
    return shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(k)


def shapley_values(rows: DataFrame, features: Sequence[str], background: Sequence[float], predict: Callable[[np.ndarray], np.ndarray], *, permutations: int = 32, seed: int = 42) -> DataFrame:
    """(id, feature, shap): sampled Shapley values against one background row, in Arrow batches.

    The permutations are fixed by the seed, each used forwards and backwards, so values sum
    to prediction minus background prediction exactly.
    """
    order = [np.random.default_rng([seed, i]).permutation(len(features)) for i in range(permutations)]
    base, names = np.asarray(background, float), list(features)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = b[names].to_numpy(float)
            total = np.zeros_like(x)
            for p in itertools.chain(order, (o[::-1] for o in order)):
                now = np.tile(base, (len(x), 1))
                before = predict(now)
                for j in p:
                    now[:, j] = x[:, j]
                    after = predict(now)
                    total[:, j] += after - before
                    before = after
            total /= 2 * len(order)
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), len(names)), "feature": names * len(x), "shap": total.ravel()})

    return rows.select("id", *names).mapInPandas(run, f"id {kind}, feature string, shap double")


def counterfactual_flips(rows: DataFrame, actionable: Sequence[str], predict: Callable[[Mapping[str, Column]], Column], *, cut: float = 0.5) -> DataFrame:
    """(id, flips, probability): the smallest set of 0/1 features to flip that lifts a row over the cut.

    All 2^n sets of the (few) actionable features are scored; ties go to the highest
    probability, then to the set's order. Rows already over the cut are left out.
    """
    if len(actionable) > 10:
        raise ValueError("too many actionable features to enumerate")
    base = rows.withColumn("p_", predict({})).where(F.col("p_") < cut)
    options = []
    for n in range(1, len(actionable) + 1):
        for chosen in itertools.combinations(actionable, n):
            p = predict({c: 1 - F.col(c) for c in chosen})
            options.append(F.struct(F.lit(n).alias("n"), (-p).alias("minus_p"), F.array(*[F.lit(c) for c in chosen]).alias("flips")))
    good = F.filter(F.array(*options), lambda o: -o["minus_p"] >= cut)
    best = base.select("id", F.array_min(good).alias("b_")).where("b_ IS NOT NULL")
    return best.select("id", "b_.flips", (-F.col("b_.minus_p")).alias("probability"))
