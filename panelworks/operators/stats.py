"""Statistics of tables, scores and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.operators.scoring import BLOCK, grouped_percentiles, percentiles, value_ranks


def score_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, median, population deviation, min, max, p10, p25, p75, p90; no row if empty."""
    x = F.col(column)
    one = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    one = one.crossJoin(percentiles(df, column, (0.10, 0.25, 0.5, 0.75, 0.90), "p_"))  # one row each
    return one.where("n > 0").select("n", "mean", F.col("p_")[2].alias("median"), "std", "min", "max", *[F.col("p_")[i].alias(n) for i, n in ((0, "p10"), (1, "p25"), (3, "p75"), (4, "p90"))])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max) of numeric columns; std is the sample deviation, nulls are left out."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x_")
    moments = long.groupBy("column").agg(F.count("x_").alias("n"), F.avg("x_").alias("mean"), F.stddev_samp("x_").alias("std"), F.min("x_").alias("min"), F.max("x_").alias("max"))
    p = grouped_percentiles(long, "column", "x_", (0.25, 0.5, 0.75)).select("column", *[F.col("p")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))])
    return moments.join(p, "column", "left").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_null) of columns with nulls, most first."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_null").where("n_null > 0").orderBy(F.desc("n_null"), "column")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, type, n, pct_missing, n_unique); a null counts as one value of n_unique.

    Values are counted by (column, value as text), so that a column of many values is spread.
    """
    types = dict(df.dtypes)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value_")
    values = long.groupBy("column", "value_").agg(F.count("*").alias("c_"))
    n, missing = F.sum("c_"), F.coalesce(F.sum(F.when(F.col("value_").isNull(), F.col("c_"))), F.lit(0))
    found = values.groupBy("column").agg(n.alias("n"), (F.try_divide(missing, n) * 100).alias("pct_missing"), F.count("*").alias("n_unique"))
    kind = F.coalesce(*[F.when(F.col("column") == c, F.lit(types[c])) for c in columns])
    return found.select("column", kind.alias("type"), "n", "pct_missing", "n_unique")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share): nulls count as a value; most frequent first, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("t_")))  # one row
    return counts.crossJoin(total).select("value", "n", (F.col("n") / F.col("t_")).alias("share")).orderBy(F.desc("n"), "value")


def mode_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, top, pct): the most frequent non-null value (ties: the least) and its share of non-nulls, in one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "top").where("top IS NOT NULL")
    counts = long.groupBy("column", "top").agg(F.count("*").alias("n_"))
    found = counts.groupBy("column").agg(F.min_by("top", F.struct((-F.col("n_")).alias("m"), "top")).alias("top"), (F.max("n_") / F.sum("n_") * 100).alias("pct"))
    frame = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return frame.join(found, "column", "left")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n): equal-width bins from min to max, the last one closed; empty bins kept."""
    ends = df.agg(F.min(column).cast("double").alias("lo_"), F.max(column).cast("double").alias("hi_"))
    width = (F.col("hi_") - F.col("lo_")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo_")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    counts = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(ends)
    return frame.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo_") + F.col("bin") * width).alias("low"), (F.col("lo_") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def cut_median(df: DataFrame, by: str, value: str, bins: int = 20) -> DataFrame:
    """(bin, n, median): medians of ``value`` in right-closed equal-width bins of ``by``; the minimum is in bin 1."""
    ends = df.agg(F.min(by).cast("double").alias("lo_"), F.max(by).cast("double").alias("hi_"))
    width = F.nullif((F.col("hi_") - F.col("lo_")) / bins, F.lit(0.0))
    at = F.coalesce(F.greatest(F.ceil((F.col(by) - F.col("lo_")) / width), F.lit(1)), F.lit(1)).cast("int")
    binned = df.where(F.col(by).isNotNull()).crossJoin(F.broadcast(ends)).select(at.alias("bin"), F.col(value).alias("value_"))
    medians = grouped_percentiles(binned, "bin", "value_", (0.5,)).select("bin", F.col("p")[0].alias("median"))
    return binned.groupBy("bin").agg(F.count("*").alias("n")).join(medians, "bin", "left")


def correlations(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """(a, b, r): Pearson correlations of pairs (or of each column with ``target``), pairwise complete."""
    pairs = [(c, target) for c in columns] if target else [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(flag, pct): share of rows where the flag is 1; nulls stay in the denominator."""
    one = df.agg(*[(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) / F.count("*") * 100).alias(c) for c in flags])
    return one.unpivot([], list(flags), "flag", "pct")


def integrity(panel: DataFrame, key: str, other: str, date: str = "date") -> DataFrame:
    """One row: repeated (other, date), keys with several others, others with several keys."""
    repeated = panel.groupBy(other, date).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_repeated"))
    pairs = panel.select(key, other).distinct()
    several = lambda a, b, to: pairs.groupBy(a).agg(F.countDistinct(b).alias("c")).agg(F.count_if(F.col("c") > 1).alias(to))
    return repeated.crossJoin(several(key, other, "n_keys_split")).crossJoin(several(other, key, "n_others_split"))  # one row each


def reconcile(panel: DataFrame, metric: str, key: str, other: str, tolerance: float = 1.0) -> DataFrame:
    """One row: totals by two keys and overall, and whether they agree within the tolerance."""
    by = lambda k, to: panel.groupBy(k).agg(F.sum(metric).alias("s")).agg(F.sum("s").alias(to))
    one = by(key, "by_key").crossJoin(by(other, "by_other")).crossJoin(panel.agg(F.sum(metric).alias("overall")))
    near = (F.abs(F.col("by_key") - F.col("overall")) <= tolerance) & (F.abs(F.col("by_other") - F.col("overall")) <= tolerance)
    return one.withColumn("agree", near)


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean) of a family of columns."""
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: mae, rmse, smape (0 over 0 counts with denominator 1), mape (actuals other than 0), r2 (0 without variance)."""
    y, p = F.col(actual), F.col(predicted)
    both = (F.abs(y) + F.abs(p)) / 2
    res = F.sum(F.pow(y - p, 2.0))
    tot = F.var_pop(y) * F.count(y)
    return df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg(F.pow(y - p, 2.0))).alias("rmse"),
        (F.avg(F.abs(y - p) / F.when(both == 0, 1.0).otherwise(both)) * 100).alias("smape"),
        (F.avg(F.when(y != 0, F.abs((y - p) / F.nullif(y, F.lit(0.0))))) * 100).alias("mape"),
        F.when(tot == 0, 0.0).otherwise(1 - res / F.nullif(tot, F.lit(0.0))).alias("r2"),
    )


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve by average ranks (exact with ties); null with one class only."""
    counts = df.groupBy(F.col(score)).agg(F.sum(F.col(label).cast("long")).alias("pos_"))
    r = value_ranks(df, score, descending=False).join(counts, score)
    average = F.col("n_before") + (F.col("n_equal") + 1) / 2
    one = r.agg(F.sum(average * F.col("pos_")).alias("s_"), F.sum("pos_").cast("double").alias("p_"), F.sum(F.col("n_equal") - F.col("pos_")).cast("double").alias("n_"))
    return one.select(F.try_divide(F.col("s_") - F.col("p_") * (F.col("p_") + 1) / 2, F.col("p_") * F.col("n_")).alias("auc"))


def classification_metrics(df: DataFrame, label: str, probability: str, cut: float = 0.5) -> DataFrame:
    """One row: auc, precision, recall, f1 at the cut (0 where undefined), log_loss (clipped at 1e-15)."""
    y, p = F.col(label), F.col(probability)
    hit = p >= cut
    tp, fp, fn = F.count_if(hit & (y == 1)), F.count_if(hit & (y == 0)), F.count_if(~hit & (y == 1))
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    one = df.agg(zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(tp, tp + fn)).alias("recall"), zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), (-F.avg(F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))
    return auc(df, label, probability).crossJoin(one)  # one row each


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, precision): one point for every distinct score, highest first."""
    counts = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"))
    totals = df.agg(F.sum(F.col(label).cast("long")).alias("p_"), F.count("*").alias("t_"))
    joined = value_ranks(df, score).join(counts, score)
    # Positives at or above a score: those of whole blocks of values ahead, and of the values before it in its block.
    block = F.floor((F.col("dense") - 1) / BLOCK)
    sums = joined.groupBy(block.alias("b_")).agg(F.sum("pos").alias("s_"))
    ahead = sums.select("b_", F.coalesce(F.sum("s_").over(W.orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead_"))
    tp = F.col("ahead_") + F.sum("pos").over(W.partitionBy("b_").orderBy("dense"))
    out = joined.withColumn("b_", block).join(ahead, "b_").withColumn("tp", tp).withColumn("fp", F.col("n_before") + F.col("n_equal") - F.col("tp"))
    out = out.crossJoin(F.broadcast(totals))
    return out.select(F.col(score).alias("threshold"), "tp", "fp", F.try_divide("tp", "p_").alias("tpr"), F.try_divide(F.col("fp"), F.col("t_") - F.col("p_")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every pair of labels that occurs."""
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of average ranks of the rows that have both values."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        r = value_ranks(rows, c, descending=False)
        rows = rows.join(r.select(c, (F.col("n_before") + (F.col("n_equal") + 1) / 2).alias(f"rank_{c}")), c)
    return rows.agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"))


def brier(df: DataFrame, label: str, raw: str, calibrated: str) -> DataFrame:
    """One row: Brier scores before and after calibration, and the improvement."""
    score = lambda p: F.avg(F.pow(F.col(p) - F.col(label), 2.0))
    one = df.agg(score(raw).alias("brier_raw"), score(calibrated).alias("brier_calibrated"))
    return one.withColumn("improvement", F.col("brier_raw") - F.col("brier_calibrated"))


def reliability(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_predicted, observed): equal-width bins of [0, 1], closed on the left, empty ones with nulls."""
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(found), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # ``bins`` rows


def ece(bins: DataFrame) -> DataFrame:
    """One row: expected calibration error of :func:`reliability` bins; null if all are empty."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))), F.sum("n")).alias("ece"))


def conformal_threshold(calibration: DataFrame, label: str, probability: str, alpha: float = 0.1, *, split: bool = True) -> DataFrame:
    """One row (threshold) on positive-class probabilities.

    split: 1 minus the ceil((n + 1)(1 - alpha)) smallest nonconformity 1 - p(true class).
    Otherwise the simple rule: element int((1 - alpha) n) - 1 of the ordered probabilities of
    positive rows.
    """
    y, p = F.col(label), F.col(probability)
    if split:
        rows = calibration.select((1 - F.when(y == 1, p).otherwise(1 - p)).alias("s"))
    else:
        rows = calibration.where(y == 1).select(p.alias("s"))
    ranks = value_ranks(rows, "s", descending=False)
    n = F.col("n_all")
    at = F.least(F.ceil((n + 1) * (1 - alpha)) - 1, n - 1) if split else F.greatest(F.floor((1 - alpha) * n) - 1, F.lit(0))
    hit = ranks.where((F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n_equal")))
    return hit.agg((1 - F.max("s") if split else F.max("s")).alias("threshold"))


def conformal_sets(df: DataFrame, probability: str, threshold: DataFrame) -> DataFrame:
    """``has_1``, ``has_0``, ``set_size``: classes whose probability reaches the threshold."""
    p, t = F.col(probability), F.col("threshold")
    out = df.crossJoin(F.broadcast(threshold)).withColumn("has_1", p >= t).withColumn("has_0", 1 - p >= t).drop("threshold")
    return out.withColumn("set_size", F.col("has_1").cast("int") + F.col("has_0").cast("int"))


def conformal_coverage(sets: DataFrame, label: str) -> DataFrame:
    """One row: coverage, mean set size, % uncertain (two classes), % empty."""
    covered = F.when(F.col(label) == 1, F.col("has_1")).otherwise(F.col("has_0")).cast("double")
    return sets.agg(F.avg(covered).alias("coverage"), F.avg("set_size").alias("avg_set_size"), (F.avg((F.col("set_size") == 2).cast("double")) * 100).alias("pct_uncertain"), (F.avg((F.col("set_size") == 0).cast("double")) * 100).alias("pct_empty"))


def coverage_text(coverage: DataFrame, alpha: float = 0.1) -> DataFrame:
    """``text``: what :func:`conformal_coverage` says, as a sentence."""
    level = F.when(F.col("coverage") >= 1 - alpha, "met").otherwise("missed")
    return coverage.withColumn("text", F.format_string("coverage %.1f%% (target %.1f%% %s), %.1f%% uncertain, %.1f%% empty", F.col("coverage") * 100, F.lit((1 - alpha) * 100), level, F.col("pct_uncertain"), F.col("pct_empty")))


def stability(runs: DataFrame, metric: str) -> DataFrame:
    """(model, mean, std, cv) over the runs of each model; std is the sample deviation, cv over max(|mean|, 1e-6)."""
    m = F.avg(metric)
    return runs.groupBy("model").agg(m.alias("mean"), F.stddev_samp(metric).alias("std"), (F.stddev_samp(metric) / F.greatest(F.abs(m), F.lit(1e-6))).alias("cv"))


def argmax(scores: Column) -> Column:
    """Index (from 0) of the largest element of an array, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sizes_with_zeros(df: DataFrame, column: str, k: int) -> DataFrame:
    """(cluster, n) for clusters 0 to k - 1, empty ones with 0."""
    counts = df.groupBy(F.col(column).cast("int").alias("cluster")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return frame.join(F.broadcast(counts), "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # k rows
