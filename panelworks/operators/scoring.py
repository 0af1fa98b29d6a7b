"""Scores, ranks, tiers and their summaries.

Ranks and percentiles over a whole table need a total order. They are computed from the
counts of each value, which are sorted in range partitions and added up over them, so that
no task sorts or holds more than its part of the different values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.scalar import clip, out_of_ten, tier, tier_part
from panelworks.session import materialise

#: Values whose counts one task adds up.
BLOCK = 65_536


def revenue_score(df: DataFrame, metric: str, *, status: str = "status", active: str = "Active") -> DataFrame:
    """``revenue_score``: the metric between p20 and p95 of active rows, cut to [0, 1]; 0 if the two meet."""
    p = percentiles(df.where(F.col(status) == active), metric, (0.2, 0.95), "p_")
    low, high = F.col("p_")[0], F.col("p_")[1]
    score = F.when(high > low, clip((F.col(metric) - low) / (high - low), 0.0, 1.0)).otherwise(0.0)
    return df.crossJoin(F.broadcast(p)).withColumn("revenue_score", F.coalesce(score, F.lit(0.0))).drop("p_")  # one row


def _numbered(df: DataFrame, order: list[Column], to: str) -> DataFrame:
    """Number rows from 1 in the given total order, sorting range partitions apart.

    The sorted partitions are written to the shared scratch folder (an action), because the
    rows and the partitions' sizes must come from one and the same division.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mono_", F.monotonically_increasing_id())
    spread = materialise(spread, "numbered")
    part = F.shiftright("mono_", 33).alias("part_")
    sizes = spread.groupBy(part).agg(F.count("*").alias("n_"))
    # One row for each range partition.
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = F.col("mono_").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.withColumn("part_", part).join(F.broadcast(before), "part_").withColumn(to, F.col("before_") + own + 1).drop("part_", "mono_", "before_")


def _counted_before(counts: DataFrame, order: list[Column]) -> DataFrame:
    """``counts`` with ``dense`` (number in the order) and ``n_before``: the sum of n_equal over the rows before."""
    numbered = _numbered(counts, order, "dense")
    block = F.floor((F.col("dense") - 1) / BLOCK)
    blocks = numbered.groupBy(block.alias("block_")).agg(F.sum("n_equal").alias("s_"))
    # One row for every BLOCK values.
    ahead = blocks.select("block_", F.coalesce(F.sum("s_").over(W.orderBy("block_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))
    inner = F.coalesce(F.sum("n_equal").over(W.partitionBy("block_").orderBy("dense").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = numbered.withColumn("block_", block).withColumn("inner_", inner).join(ahead, "block_")
    return out.withColumn("n_before", F.col("ahead_") + F.col("inner_")).drop("block_", "inner_", "ahead_")


def value_ranks(df: DataFrame, score: str, *, descending: bool = True) -> DataFrame:
    """(score, n_before, n_equal, n_all, dense): for each distinct value the rows before it in order."""
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n_equal"))
    out = _counted_before(counts, [F.desc(score) if descending else F.asc(score)])
    total = counts.agg(F.sum("n_equal").alias("n_all"))
    return out.crossJoin(F.broadcast(total)).select(score, "n_before", "n_equal", "n_all", "dense")


#: Relative rank error of the sketch that brackets exact percentiles, as its inverse.
SKETCH = 20_000


def grouped_percentiles(rows: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(by, n, p): exact percentiles of every group's values, with linear interpolation between neighbours.

    Nulls are left out; a group without values has no row. Two aggregations: a mergeable sketch
    brackets each wanted rank by two values, then the values within a bracket (a few of
    ``SKETCH`` parts of the rows) are counted, all below as one, and the neighbours are read off.
    """
    named = rows.select(F.col(by).alias("by_"), F.col(value).cast("double").alias("value_")).where("value_ IS NOT NULL")
    slack = 2 / SKETCH
    ends = [max(q - slack, 0.0) for q in shares] + [min(q + slack, 1.0) for q in shares]
    found = named.groupBy("by_").agg(F.count("*").alias("n"), F.min("value_").alias("least_"), F.max("value_").alias("most_"), F.percentile_approx("value_", [float(e) for e in ends], SKETCH).alias("e_"))
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    brackets = []
    for i, q in enumerate(shares):
        few = F.col("n") * slack < 4  # all of a small group
        low = F.col("least_") if q <= slack else F.when(few, F.col("least_")).otherwise(F.col("e_")[i])
        high = F.col("most_") if q >= 1 - slack else F.when(few, F.col("most_")).otherwise(F.col("e_")[len(shares) + i])
        brackets.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high")))
    sizes = found.select("by_", "n", F.array(*brackets).alias("brackets_"))
    # Null is a group as any other.
    met = named.withColumnRenamed("by_", "own_").join(sizes, F.col("own_").eqNullSafe(F.col("by_")))
    near = met.select("by_", "n", "value_", F.explode("brackets_").alias("b_")).where(F.col("value_") <= F.col("b_.high"))
    # What lies below a bracket is counted under null, which is first in the order.
    inside = F.when(F.col("value_") >= F.col("b_.low"), F.col("value_"))
    counts = near.groupBy("by_", "n", F.col("b_.i").alias("i"), inside.alias("v_")).agg(F.count("*").alias("c_"))
    before = F.sum("c_").over(W.partitionBy("by_", "i").orderBy(F.asc_nulls_first("v_")).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c_")
    rank = F.element_at(F.array(*[at(q) for q in shares]), F.col("i") + 1)
    hit = lambda k: F.max(F.when((F.col("before_") <= k) & (k < F.col("before_") + F.col("c_")), F.col("v_")))
    ranked = counts.withColumn("before_", before).withColumn("rank_", rank)
    picked = ranked.groupBy("by_", "n", "i", "rank_").agg(hit(F.floor("rank_")).alias("lo_"), hit(F.ceil("rank_")).alias("hi_"))
    between = F.col("lo_") + (F.col("hi_") - F.col("lo_")) * (F.col("rank_") - F.floor("rank_"))
    each = picked.select("by_", "n", "i", F.coalesce(between, F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")).alias("x_"))
    one = each.groupBy("by_").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("x_"))).alias(f"x{i}_") for i in range(len(shares))])
    return one.select(F.col("by_").alias(by), "n", F.array(*[f"x{i}_" for i in range(len(shares))]).alias("p"))


def percentiles(df: DataFrame, column: str | Column, shares: Sequence[float], to: str = "p") -> DataFrame:
    """One row: an array of exact percentiles (linear interpolation); null if there are no values."""
    values = df.select(F.lit(0).alias("all_"), (F.col(column) if isinstance(column, str) else column).alias("x_"))
    return grouped_percentiles(values, "all_", "x_", shares).agg(F.max("p").alias(to))


def column_percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], prefix: str = "p_") -> DataFrame:
    """One row: ``<prefix><column>`` arrays of percentiles for several columns, all by one sort."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name_", "x_")
    found = grouped_percentiles(long, "name_", "x_", shares)
    return found.agg(*[F.max(F.when(F.col("name_") == c, F.col("p"))).alias(f"{prefix}{c}") for c in columns])


def rank_percentile(df: DataFrame, score: str, *, method: str = "average", digits: int | None = 1) -> DataFrame:
    """``rank`` (1 is the highest) and ``percentile`` = (n - rank) / n * 100, rounded to ``digits`` (halves to even; None: not at all).

    Ties share the average of their ranks, cut to a whole number; ``method='dense'`` numbers
    distinct scores. Null scores have null ranks.
    """
    r = value_ranks(df, score)
    average = F.floor(F.col("n_before") + 1 + (F.col("n_equal") - 1) / 2).cast("int")
    r = r.select(score, (average if method == "average" else F.col("dense").cast("int")).alias("rank"), F.col("n_all").alias("n_"))
    percentile = (F.col("n_") - F.col("rank")) / F.col("n_") * 100
    return df.join(r, score, "left").withColumn("percentile", percentile if digits is None else F.bround(percentile, digits)).drop("n_")


def dual_rank(df: DataFrame, first: str, second: str, key: str = "id") -> DataFrame:
    """``<first>_rank`` and ``<second>_rank``: row numbers by each measure, descending, ties by key."""
    out = _numbered(df, [F.desc_nulls_last(first), F.asc(key)], f"{first}_rank")
    return _numbered(out, [F.desc_nulls_last(second), F.asc(key)], f"{second}_rank")


def top_flag(df: DataFrame, score: str, n: int, to: str = "top", key: str = "id") -> DataFrame:
    """1 for the n highest scores (ties by key), else 0."""
    best = df.orderBy(F.desc_nulls_last(score), key).limit(n).select(key, F.lit(1).alias(to))
    return df.join(best, key, "left").withColumn(to, F.coalesce(to, F.lit(0)))


def percentile_of_score(df: DataFrame, score: str) -> DataFrame:
    """``pct`` = (rows below + rows up to + 1) * 50 / n for each value among the scores."""
    r = value_ranks(df, score, descending=False)
    pct = (F.col("n_before") + F.col("n_before") + F.col("n_equal") + 1) * 50.0 / F.col("n_all")
    return df.join(r.select(score, pct.alias("pct")), score, "left")


def quintile(df: DataFrame, score: str, to: str) -> DataFrame:
    """0 to 4 by the score's own p20, p40, p60 and p80 (a value at an edge goes up)."""
    p = percentiles(df, score, (0.2, 0.4, 0.6, 0.8), "p_")
    x = F.col(score)
    number = sum(((x >= F.col("p_")[i]).cast("int") for i in range(1, 4)), (x >= F.col("p_")[0]).cast("int"))
    return df.crossJoin(F.broadcast(p)).withColumn(to, number).drop("p_")  # one row


def compare_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two tables (id, score): common ids, Pearson, mean absolute difference, quintile agreement %."""
    both = a.select("id", F.col("score").alias("a")).join(b.select("id", F.col("score").alias("b")), "id")
    both = quintile(quintile(both, "a", "qa"), "b", "qb")
    same = F.count_if(F.col("qa") == F.col("qb"))
    return both.agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), (F.try_divide(same, F.count("*")) * 100).alias("quintile_agreement"))


def largest_differences(a: DataFrame, b: DataFrame, n: int = 20) -> DataFrame:
    """The n ids whose two scores differ most, ties by id."""
    both = a.select("id", F.col("score").alias("a")).join(b.select("id", F.col("score").alias("b")), "id")
    return both.withColumn("diff", F.abs(F.col("a") - F.col("b"))).orderBy(F.desc("diff"), "id").limit(n)


def priority(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``priority``: weighted sum of the columns' average-rank shares (rank / n, 1 is the highest value)."""
    out, total = df, F.lit(0.0)
    for c, w in weights.items():
        r = value_ranks(df, c, descending=False)
        share = (F.col("n_before") + 1 + (F.col("n_equal") - 1) / 2) / F.col("n_all")
        out = out.join(r.select(c, share.alias(f"share_{c}")), c, "left")
        total = total + w * F.col(f"share_{c}")
    return out.withColumn("priority", total).drop(*[f"share_{c}" for c in weights])


def category(scores: DataFrame, training: DataFrame, active: DataFrame) -> DataFrame:
    """``category``: TRAINING for ids used in training, else ACTIVE or NON_ACTIVE."""
    t = training.select("id").distinct().withColumn("t_", F.lit(True))
    a = active.select("id").distinct().withColumn("a_", F.lit(True))
    label = F.when(F.col("t_"), "TRAINING").when(F.col("a_"), "ACTIVE").otherwise("NON_ACTIVE")
    return scores.join(t, "id", "left").join(a, "id", "left").withColumn("category", label).drop("t_", "a_")


def classify_tiers(df: DataFrame, probability: str = "p") -> DataFrame:
    """``tier``, ``label``, ``action``, ``confidence`` of each probability; a bad one gives nulls and ``error``."""
    p = F.col(probability)
    out = df.withColumn("tier", tier(p)).withColumn("label", tier_part(F.col("tier"), 2)).withColumn("action", tier_part(F.col("tier"), 3))
    out = out.withColumn("confidence", F.when(F.col("tier").isNotNull(), out_of_ten(p)))
    return out.withColumn("error", F.when(F.col("tier").isNull(), "no probability"))


def tier_distribution(tiers: DataFrame) -> DataFrame:
    """(tier, n, share) of tiers 1 to 4, zeros included."""
    counts = tiers.where(F.col("tier").isNotNull()).groupBy("tier").agg(F.count("*").alias("n"))
    all_ = tiers.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("tier"))
    joined = all_.join(F.broadcast(counts), "tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # four rows
    return joined.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(F.lit(1)))), F.lit(0.0)))


def tier_history(outcomes: DataFrame, least: int = 10) -> DataFrame:
    """(tier, n, accuracy): share of successes, null below ``least`` outcomes."""
    n = F.count("*")
    return outcomes.groupBy("tier").agg(n.alias("n"), F.when(n >= least, F.avg(F.col("succeeded").cast("double"))).alias("accuracy"))


def tier_shift(counts: DataFrame, interventions: DataFrame, *, effect: float = 0.6) -> DataFrame:
    """(tier, before, after): tiers once interventions (ord, n, rate) have moved their sites up to tier 2.

    Each moves int(n * rate * effect): half from tier 3 (as far as it has), the rest from tier
    4 (likewise), one after another in the order of ``ord``. There are few interventions.
    """
    steps = interventions.agg(F.array_sort(F.collect_list(F.struct("ord", F.floor(F.col("n") * F.col("rate") * effect).cast("long").alias("moved")))).alias("steps"))
    state = counts.agg(*[F.coalesce(F.max(F.when(F.col("tier") == t, F.col("n"))), F.lit(0)).cast("long").alias(f"t{t}") for t in (1, 2, 3, 4)])
    start = F.struct(F.col("t2").alias("t2"), F.col("t3").alias("t3"), F.col("t4").alias("t4"))

    def step(s: Column, x: Column) -> Column:
        from3 = F.least(F.floor(x["moved"] / 2).cast("long"), s["t3"])
        from4 = F.least(x["moved"] - from3, s["t4"])
        return F.struct((s["t2"] + from3 + from4).alias("t2"), (s["t3"] - from3).alias("t3"), (s["t4"] - from4).alias("t4"))

    end = state.crossJoin(steps).withColumn("end", F.aggregate("steps", start, step))
    rows = [F.struct(F.lit(t).alias("tier"), F.col(f"t{t}").alias("before"), (F.col("t1") if t == 1 else F.col(f"end.t{t}")).alias("after")) for t in (1, 2, 3, 4)]
    return end.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
